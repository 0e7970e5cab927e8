"""Injected functions: a model's part of the work, and what stands in where it fails.

Each takes a plain Python function that the caller brings. Spark deals the rows; a function that raises or answers
badly never stops a job, it falls back to the rule named here."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import spread_sample


def transcribe(chunks: DataFrame, transcriber: Callable[[str], list[dict]], by: Sequence[str] = ("source_id", "chunk_index"), path: str = "path", start: str = "r_start") -> DataFrame:
    """(by, seg_idx, start_ms, end_ms, text) on the source's axis: what transcriber(path) hears in each chunk, as dicts of
    start_ms, end_ms and text, moved by the chunk's start. A chunk whose transcriber raises has no segments."""
    kinds = dict(chunks.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                try:
                    heard = transcriber(r[path])
                except Exception:  # noqa: BLE001  (whatever a model raises)
                    heard = []
                rows += [(*(r[c] for c in by), i, r[start] + s["start_ms"], r[start] + s["end_ms"], s["text"]) for i, s in enumerate(heard)]
            yield pd.DataFrame(rows, columns=[*by, "seg_idx", "start_ms", "end_ms", "text"])

    shape = ", ".join([*(f"{c} {kinds[c]}" for c in by), "seg_idx long, start_ms long, end_ms long, text string"])
    return chunks.select(*by, path, start).mapInPandas(run, shape)


def shorten(text: Column, target: Column, shortener: Callable[[str, int], str] | None = None, blanks: str | None = None) -> Column:
    """Texts longer than `target` characters by shortener(text, target), without `blanks` (all white space) at the ends; cut and
    closed with a point where there is none, or it raises, or gives nothing new. Shorter texts stay."""

    def cut(text: str, most: int) -> str:
        return text[:most].rstrip("., \t\n") + "."

    @F.pandas_udf("string")
    def run(texts: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for t, most in zip(texts, targets, strict=True):
            if t is None or len(t) <= most:
                out.append(t)
                continue
            try:
                told = (shortener(t, int(most)) or "") if shortener else ""
                new = told.strip(blanks)
            except Exception:  # noqa: BLE001
                told = new = ""
            out.append(new if new and t not in (told, new) else cut(t, int(most)))
        return pd.Series(out, dtype=object)

    return run(text, target)


def relate(candidates: DataFrame, by: Sequence[str], extract: Callable[[list[dict]], list[dict]], fields: Sequence[str]) -> DataFrame:
    """(by, a, b, type): the edges that extract(rows) finds among a source's candidates, sent with `fields` only; none
    where it raises."""
    kinds = dict(candidates.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = [frame[c].iloc[0] for c in by]
        try:
            edges = extract(frame[list(fields)].to_dict("records"))
        except Exception:  # noqa: BLE001
            edges = []
        return pd.DataFrame([(*own, e["a"], e["b"], e["type"]) for e in edges], columns=[*by, "a", "b", "type"])

    shape = ", ".join([*(f"{c} {kinds[c]}" for c in by), "a long, b long, type string"])
    return candidates.select(*dict.fromkeys([*by, *fields])).groupBy(*by).applyInPandas(run, shape)


def chosen_drops(beats: DataFrame, by: Sequence[str], clip: str, beat: str, choose: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    """(by, clip, beat, place): the order in which beats may be dropped: as choose(rows) says, its bad entries left out; by
    importance (droppable, then supporting; never core) where it says nothing or raises."""
    kinds = dict(beats.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values([clip, beat]).to_dict("records")
        known = {(r[clip], r[beat]) for r in rows}
        picked: list[tuple] = []
        if choose:
            try:
                picked = [(d["clip"], d["beat"]) for d in choose(rows) if isinstance(d, dict) and (d.get("clip"), d.get("beat")) in known]
            except Exception:  # noqa: BLE001
                picked = []
        if not picked:
            rank = {"droppable": 0, "supporting": 1}
            picked = [(r[clip], r[beat]) for r in sorted((r for r in rows if r["importance"] in rank), key=lambda r: rank[r["importance"]])]
        own = [frame[c].iloc[0] for c in by]
        return pd.DataFrame([(*own, *p, i) for i, p in enumerate(dict.fromkeys(picked))], columns=[*by, clip, beat, "place"])

    shape = ", ".join([*(f"{c} {kinds[c]}" for c in (*by, clip, beat)), "place long"])
    return beats.groupBy(*by).applyInPandas(run, shape)


def fallback_story(candidates: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """A story without a model: candidates at positions 0, n/3, 2n/3 and n - 1 as hook, two builds and the payoff."""
    last = F.max("place").over(Window.partitionBy(*by))
    role = F.when(F.col("place") == 0, "hook").when(F.col("place") == last, "payoff").otherwise("build")
    return spread_sample(candidates, by, order).withColumn("role", role)
