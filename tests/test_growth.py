"""What a step must not carry along as tables grow, beside results that stay those of the SQL."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from spanwise.operators import contract, graph, intervals, quotes
from spanwise.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_label_sorts_no_vectors(spark, tmp_path):
    """Labels of one block need no grouping by vector; those of several group what was found, not vectors."""
    assert "SortAggregate" not in _plan(QUERIES["vec_nearest_label"](spark, DATA))
    rows = spark.range(600).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast(pmod(xxhash64(id % 300, i), 1000) + id % 7 as float)) as embedding", "cast(id % 300 as int) as label")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = QUERIES["vec_nearest_label"](spark, str(tmp_path)).select("vec_id", "label", "nearest")
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"select vec_id, label, nearest from ({ORACLE['vec_nearest_label']})").fetchall())


def test_stories_are_judged_without_a_join(spark):
    """Answers are parsed and judged once, in the rows that are read."""
    plan = _plan(QUERIES["story_rows"](spark, DATA))
    assert "Join" not in plan and "Exchange" not in plan


def test_a_node_meets_its_section_at_once(spark):
    """No row a node and a rule: sections bring their rules as one row. Numbers read from text are those of the values."""
    assert "rules#" in _plan(contract.violations(spark.createDataFrame([(1, "{}")], "k long, document string"), "k"))
    told = '[1, 1.5, -2e3, 1e400, 12345678901234567890, 0.0000001, true, false, "1e3", " 2 ", "x", "", "1d", null, [1], {"a": 1}]'
    items = spark.createDataFrame([(told,)], "v string").selectExpr("posexplode(try_variant_get(try_parse_json(v), '$', 'array<variant>')) as (i, v)")
    found = [r[0] for r in items.select("i", contract.number(F.col("v")).alias("n")).orderBy("i").select("n").collect()]
    assert found == [1.0, 1.5, -2000.0, None, 12345678901234567890.0, 1e-7, 1.0, 0.0, 1000.0, 2.0, None, None, None, None, None, None]


def test_components_spread_over_linked_nodes_only(spark, monkeypatch):
    """Rows without edges take part in no round; edges to unknown rows link nothing."""
    kept = []
    whole = DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **b: kept.append(whole(self, *a, **b)) or kept[-1])
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 7), (5, 1000), (1000, 6)], "a long, b long")
    found = graph.components(spark.range(100), edges, "id")
    assert {r["id"]: r["root"] for r in found.collect()} == {n: 1 if n in (2, 3) else n for n in range(100)}
    assert max(df.count() for df in kept) <= 10


@pytest.mark.parametrize("few", [0, 100_000])
def test_passages_do_not_travel_with_their_grams(spark, monkeypatch, few):
    """A passage has up to 40 rows of grams: these hold hashes and keys. Every place is still found, for passages told twice too, and none by a gram alone."""
    monkeypatch.setattr(quotes, "FEW", few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = "".join(chr(97 + n * n % 23) + str(n * 7919 % 101) for n in range(60))
        texts = [(1, "x" * 25), (1, "q" + long + long), (2, long[:90]), (2, "ab" * 6000), (None, long)]
        asked = [(1, 7, long[:95]), (1, 7, long[:95]), (1, None, long[:80] + "?" * 9), (1, 8, "x" * 12), (1, 8, "x" * 20), (2, 9, long[:85]), (2, 9, "ba" * 50), (1, 10, "short"), (None, 11, long[:90])]
        frame = spark.createDataFrame([(by, i, n) for i, (by, n) in enumerate(texts)], "by long, i long, n string")
        found = quotes.occurrences(frame, spark.createDataFrame(asked, "by long, k long, needle string"), ["by", "i"], ["by"])
        want = [(by, i, at, k, x) for i, (by, n) in enumerate(texts) for who, k, x in asked if by == who and by is not None and len(x) >= 10 for at in range(len(n)) if n.startswith(x, at)]
        by = lambda r: tuple((x is None, x or 0) for x in r[:4]) + (r[4],)
        assert sorted(map(tuple, found.select("by", "i", "at", "k", "needle").collect()), key=by) == sorted(want, key=by)
        dealt = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\((.*)\)", found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted"))
        assert few or any("head#" in by for _, by in dealt)
        assert not [row for row, by in dealt if "head#" in by and "needle#" in row]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _kept(c0, c1, drops, said, least):
    """(pieces left of a clip by drops, those kept of them) as the rules read, each piece against all segments."""
    if c0 is None or c1 is None or c1 <= c0:
        return [], [(c0, c1)]
    cut = sorted((max(c0, a), min(c1, z)) for a, z in drops if c0 < z and c1 > a)
    heard = [(s, e) for s, e in said if c0 < e and c1 > s]
    at, parts = c0, []
    for a, z in [*cut, (c1, c1)]:
        parts += [(at, a)] if a > at else []
        at = max(at, z)
    good = []
    for a, b in parts:
        na = min((s for s, _ in heard if a <= s < b), default=a) if a != c0 else a
        tail = max((e for _, e in heard if e <= b), default=na)
        nb = tail if b != c1 and tail > na else b
        good += [(na, nb)] if nb > na else []
    long = [(a, b) for a, b in good if b - a >= least]
    return parts, long or sorted(good, key=lambda p: (p[0] - p[1], p[0]))[:1] or [(c0, c1)]


def test_kept_intervals_are_one_sweep(spark):
    """One join and no step that sorts what another has sorted, so a task holds few sorted runs; pieces are those of the rules, at odd rows too."""
    roll = random.Random(5)
    span = lambda most: (lambda a: (a, a + roll.choice([0, 0, 1, 3, roll.randrange(most)])))(roll.randrange(60) * 10**5)
    clips = [(s, k, *span(9 * 10**5)) for s in range(6) for k in range(20)] + [(1, 90, None, 5), (1, 91, 5, None), (1, 92, 9 * 10**5, 10**5), (1, None, 0, 10**6), (1, None, 10**5, 10**7), (None, 7, 0, 10**6), (None, 8, 0, 10), (None, 8, 0, 10)]
    drops = [(s, *span(10**5)) for s in range(5) for _ in range(40)] + [(None, 0, 10**6), (1, None, 10**6), (1, 0, None)]
    said = [(s, *span(3 * 10**5)) for s in range(6) for _ in range(60)] + [(1, None, 10**5), (1, 10**5, None), (None, 0, 10**5)]
    frame = lambda rows, of: spark.createDataFrame(rows, of)
    c, d = frame(clips, "source_id long, clip long, start_ms long, end_ms long"), frame(drops, "source_id long, r_start long, r_end long")
    s = frame(said, "source_id long, start_ms long, end_ms long")
    own = lambda rows, by: [r[1:] for r in rows if r[0] == by and None not in r]
    parts, kept = [], []
    for by, k, c0, c1 in clips:
        there = by is not None
        left, stay = _kept(c0, c1, own(drops, by) if there else [], own(said, by) if there else [], 120_000)
        parts += [(by, k, *p) for p in left]
        kept += [(by, k, *p) for p in stay]
    in_order = lambda rows: sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) for x in r])
    found = intervals.kept_intervals(c, d, s, ["source_id"], "clip", 120_000)
    assert in_order(found.collect()) == in_order(kept)
    assert in_order(intervals.subtract(c, d, ["source_id"], "clip").collect()) == in_order(parts)
    plan = _plan(QUERIES["clip_kept_intervals"](spark, DATA))
    assert len(re.findall(r"Join ", plan)) == 1 and len(re.findall(r"\bSort ", plan)) <= 8
