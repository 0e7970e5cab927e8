"""Quotes in long texts: every place where a passage stands, in documents or in transcripts of many segments.

A passage is searched by a gram of it: texts give grams of ten or forty characters with the place, side by side where
passages are long enough, these meet the passages' grams in an equi-join, and only what meets is compared in full, with a piece of its text. Neither texts
nor passages travel with their grams. Transcripts are searched as one text a source, in overlapping blocks, so that no source is one row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise

HEAD, SHARE, BLOCK = 10, 0.6, 4096
#: Grams of a text, as their length and how far apart they start. A passage of length + step - 1 characters or more holds one of them whole
#: wherever it stands, and is asked for with each of `step` places where that one may start; short passages meet the grams of all places.
GRAMS = ((HEAD, 1), (HEAD, HEAD), (40, 40))
#: Up to so many grams of passages go to every executor; more are joined by a shuffle.
FEW = 100_000


def needle(quote: Column, share: float = SHARE) -> Column:
    """The leading share of a normalised quote that is searched, HEAD characters at least; null for shorter quotes."""
    return F.when(F.length(quote) >= HEAD, F.left(quote, F.greatest(F.lit(HEAD), F.floor(F.length(quote) * share)).cast("int")))


def _kinds(needles: DataFrame) -> list[tuple[int, int, int]]:
    """(kind, how many, longest) of the needles that can be searched; a kind is a place in GRAMS."""
    told = needles.where(F.length("needle") >= HEAD).groupBy(_kind().alias("kind")).agg(F.count("*"), F.max(F.length("needle")))
    return sorted(map(tuple, told.collect())) or [(0, 0, 0)]


def _kind() -> Column:
    kind = F.lit(0)
    for k, (size, step) in enumerate(GRAMS):
        kind = F.when(F.length("needle") >= size + step - 1, k).otherwise(kind)
    return kind


def occurrences(texts: DataFrame, needles: DataFrame, ids: Sequence[str], on: Sequence[str] = (), upto: int | None = None, told: Sequence[tuple[int, int, int]] = ()) -> DataFrame:
    """needles (.., needle) with ids and `at`, from 0: all places, overlapping ones too, in texts (ids, n). `on` are columns
    of both that must agree; `upto`: how many first places of a text count (all); `told`: what _kinds says of needles, if known."""
    # Rows without an `on` meet nothing; saying so here lets both uses of the passages share one shuffle.
    wanted, of_needle = needles.where(F.length("needle") >= HEAD).where(reduce(and_, (F.col(c).isNotNull() for c in on), F.lit(True))), [c for c in needles.columns if c != "needle"]
    told = told or _kinds(needles)
    longest = max(most for _, _, most in told)
    # The text is found once, before it is cut into grams or pieces: a generator keeps it from being found anew in each.
    texts = texts.where(F.length("n") >= HEAD).select(*ids, F.explode(F.array("n")).alias("n"))
    met = None
    for k, n, _ in told:
        size, step = GRAMS[k]
        own = wanted.where(_kind() == k)
        # A passage has `step` rows here, so these say whose they are, and grams are hashes: what two of them meet in by chance goes below.
        heads = F.transform(F.sequence(F.lit(1), F.lit(step)), lambda i: F.xxhash64(F.substring("needle", i, F.lit(size))))  # noqa: B023
        shifted = own.select(*of_needle, F.length("needle").alias("_len"), F.posexplode(heads).alias("_shift", "_head"))
        # Normalised texts have no surrogate pairs, so a match of the first pattern is a character further than the last.
        every = F.regexp_extract_all("n", F.lit(rf"(?=(.{{{size}}}))" if step == 1 else rf"(.{{{step}}})"), F.lit(1))
        if upto is not None:
            every = F.slice(every, 1, -(-(upto + step - 1) // step))
        of = texts
        # Texts that nothing asks for give no grams, if finding them moves no text or spares a gram a character.
        if on and (n <= FEW or step == 1):
            asked = own.select(*on).distinct()
            of = texts.join(F.broadcast(asked) if n <= FEW else asked, list(on), "left_semi")
        grams = of.select(*ids, F.posexplode(every).alias("at", "_gram")).select(*ids, "at", F.xxhash64("_gram").alias("_head"))
        if n * step <= FEW:
            grams = grams.join(F.broadcast(shifted.select(*on, "_head").distinct()), [*on, "_head"], "left_semi")
        here = grams.join(shifted, [*on, "_head"]).withColumn("at", F.col("at") * step - F.col("_shift")).where("at >= 0").drop("_shift", "_head")
        here = here if upto is None else here.where(F.col("at") < upto)
        met = here if met is None else met.unionByName(here)
    met = met.withColumn("_piece", F.floor(F.col("at") / BLOCK).cast("int"))
    # A hit meets the piece of its text that it lies in, not the text: a piece is BLOCK characters and the longest passage.
    places = F.length("n") if upto is None else F.least(F.length("n"), F.lit(upto))
    cut = F.transform(F.sequence(F.lit(0), F.floor((places - 1) / BLOCK).cast("int")), lambda b: F.substring("n", b * BLOCK + 1, F.lit(BLOCK + longest)))
    stands = F.substring("_text", (F.col("at") - F.col("_piece") * BLOCK + 1).cast("int"), F.col("_len"))
    found = met.join(texts.select(*ids, F.posexplode(cut).alias("_piece", "_text")), [*ids, "_piece"]).withColumn("needle", stands).drop("_text", "_piece", "_len")
    # What stands there is the passage, if the passages have a row of just that.
    whole = wanted.select(*(F.col(c).alias(f"_of_{c}") for c in (*of_needle, "needle")))
    return found.join(whole, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*of_needle, "needle"))), "left_semi")


def timeline(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, seg_idx, off, n, start_ms, end_ms): normalised texts of the segments and their place in the source's whole text."""
    said = segments.select(*by, "seg_idx", "start_ms", "end_ms", normalise(F.col("text")).alias("n")).where((F.length("n") > 0) & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())
    before = Window.partitionBy(*by).orderBy("start_ms", "seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    return said.withColumn("off", F.coalesce(F.sum(F.length("n")).over(before), F.lit(0)).cast("long"))


def _dealt(line: DataFrame, more: int) -> DataFrame:
    """Segments with every block that covers some of them: block b is of BLOCK characters, and `more` beyond."""
    first = F.greatest(F.lit(0), F.ceil((F.col("off") - BLOCK - more + 1) / BLOCK)).cast("long")
    last = F.floor((F.col("off") + F.length("n") - 1) / BLOCK).cast("long")
    return line.withColumn("block", F.explode(F.sequence(first, last)))


def quote_times(segments: DataFrame, needles: DataFrame, by: Sequence[str]) -> DataFrame:
    """needles (by, .., needle) with (at, s_ms, e_ms) of every place in their source's transcript: when the segments that
    hold its first and its last character start and end."""
    line = timeline(segments, by)
    told = _kinds(needles)
    longest = max(most for _, _, most in told)
    begin = F.col("block") * BLOCK
    head = F.greatest(begin - F.col("off"), F.lit(0))
    cut = F.substring("n", (head + 1).cast("int"), (begin + BLOCK + longest - F.greatest("off", begin)).cast("int"))
    pieces = _dealt(line, longest).select(*by, "block", F.struct("off", cut.alias("n")).alias("p"))
    texts = pieces.groupBy(*by, "block").agg(F.array_join(F.array_sort(F.collect_list("p"))["n"], "").alias("n"))
    found = occurrences(texts, needles, [*by, "block"], by, BLOCK, told).withColumn("at", F.col("block") * BLOCK + F.col("at")).withColumn("_last", F.col("at") + F.length("needle") - 1)
    spans = _dealt(line, 0).select(*by, "block", "off", (F.col("off") + F.length("n")).alias("to"), "start_ms", "end_ms")
    for name, place, time in (("s_ms", F.col("at"), "start_ms"), ("e_ms", F.col("_last"), "end_ms")):
        own = spans.select(*by, "block", "off", "to", F.col(time).alias(name))
        found = found.withColumn("block", F.floor(place / BLOCK).cast("long")).join(own, [*by, "block"]).where((F.col("off") <= place) & (place < F.col("to"))).drop("off", "to")
    return found.drop("block", "_last")


def quotes(df: DataFrame, keys: Sequence[str], least: int = HEAD) -> DataFrame:
    """(keys, quote_idx, quote): normalised quotes of a candidate's transcript and array `lines`, long ones alone."""
    every = F.concat(F.array(F.coalesce("transcript", F.lit(""))), F.coalesce("lines", F.array().cast("array<string>")))
    return df.select(*keys, F.posexplode(F.transform(every, normalise)).alias("quote_idx", "quote")).where(F.length("quote") >= least)


def misplaced(candidates: DataFrame, segments: DataFrame, by: Sequence[str], key: str, slack: int = 5000) -> DataFrame:
    """(by, key, problem, found_s, found_e): the first quote that the transcript holds decides. It is fine if one of its
    places starts or ends within the candidate's time and `slack` on either side; else it is a problem, and its first
    place is told. Candidates without a time, or whose quotes are not found, are fine."""
    keys = [*by, key]
    wanted = quotes(candidates, keys).withColumn("needle", needle(F.col("quote"))).drop("quote")
    hits = quote_times(segments, wanted, by).join(candidates.select(*keys, "start_ms", "end_ms"), keys)
    inside = lambda c: F.col(c).between(F.col("start_ms") - slack, F.col("end_ms") + slack)
    each = hits.groupBy(*keys, "quote_idx").agg(F.bool_or(inside("s_ms") | inside("e_ms")).alias("near"), F.min(F.struct("at", "s_ms", "e_ms")).alias("place"))
    first = each.groupBy(*keys).agg(F.min_by(F.struct("near", "place"), "quote_idx").alias("f"))
    joined = candidates.select(*keys).join(first, keys, "left")
    problem = F.coalesce(~F.col("f.near"), F.lit(False))
    told = lambda c: F.when(problem, F.col(f"f.place.{c}"))
    return joined.select(*keys, problem.alias("problem"), told("s_ms").alias("found_s"), told("e_ms").alias("found_e"))
