"""Personal data: patterns with checks, and terms that the corpus shows to disclose protected entities.

Four kinds are found by pattern (email, ip, card, phone) with their positions, in SQL: a text is split
at a pattern, and running lengths of the pieces and the matches give code point offsets.

On top of that, information-theoretic sanitisation. A protected entity is a value found above. A
term is a word without what is neither letter nor digit, lowered, of any length. The
distinct terms of every text that mentions it are counted with it over the whole corpus (a repeated text
counts once, so copies prove nothing). An entity's information is -log2 p(entity); a term reveals as much
of it as their pointwise mutual information says, with one added to the counts of entity and term, so that
the evidence of few texts weighs less. A term that reveals at least `threshold` of an entity's information
discloses it: the term is listed as a span of kind "term" wherever it stands, in any text, outside of
found values, and sanitise() generalises it to <TERM>, as it does found values to their kind.

Terms go by their hash. They are counted by one partial aggregate per task before any shuffle; only texts
with a mention give pairs, and only texts with a telling term are read for positions.

Defined results: null texts count as empty (no spans); very long texts are read whole, with possessive
patterns that run in linear time and constant stack; repeated rows are each reported; null ids stay;
an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, fresh, join_hot, settle

#: Possessive forms of the kinds' patterns: they match the same spans, and each run of characters is
#: scanned once (a match starts where its run starts, or where the last match ended).
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
THRESHOLD = 0.75
#: Up to so many telling terms or repeated texts (8 or 24 bytes each) go to every executor; more are joined by a shuffle.
FEW = 1_000_000
_ORDER = {k: i for i, k in enumerate([*KINDS, "term"])}
_BLOCK = 256


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column, sums: Column, i: Column) -> Column:
    """Sum of the first i lengths: of the whole blocks before i, and of less than a block's lengths."""
    whole = (i / _BLOCK).cast("int")
    return F.get(sums, whole) + _sum(F.slice(lengths, whole * _BLOCK + 1, i - whole * _BLOCK))


def _blocks(lengths: Column) -> Column:
    """Sums of the lengths before each block, and of all of them."""
    numbers = F.sequence(F.lit(0), F.greatest((F.size(lengths) - 1) / _BLOCK, F.lit(0)).cast("int"))
    own = F.transform(numbers, lambda b: _sum(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    return F.aggregate(own, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))


def _matches(text: Column, pattern: str, wanted=lambda value: F.lit(True)) -> Column:
    """Array of struct(start, end, value): the wanted matches with code point offsets."""

    def of(pieces: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def placed(found: Column) -> Column:
            steps = F.transform(found, lambda v, i: F.length(F.get(pieces, i)) + F.length(v))

            def one(lengths: Column, blocks: Column, v: Column, i: Column) -> Column:
                start = _before(lengths, blocks, i) + F.length(F.get(pieces, i))
                return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

            some = F.filter(F.transform(found, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda x: wanted(x["v"]))
            return let(steps, lambda lengths: let(_blocks(lengths), lambda blocks: F.transform(some, lambda x: one(lengths, blocks, x["v"], x["i"]))))

        return let(values, placed)

    return let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, of(pieces)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.length(bare(x)) < 3) | ((F.length(bare(x)) == 3) & (bare(x) <= "255")))
    digits = _digits(value)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of struct(start, end, value); empty where there is none."""
    text = F.coalesce(text, F.lit(""))
    hints = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return {k: F.coalesce(F.when(hints[k], F.filter(_matches(text, p), lambda s: _valid(k, s["value"]))), none) for k, p in KINDS.items()}  # noqa: B023


def _entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _term(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]", ""))


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: its words' letters and digits, lowered, however few they are."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), BLANKS), _term)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def _keys(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("t2")]


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, t1, t2, who, spans: struct of an array a kind, hs: terms of a text with a span), settled; t1 and t2 are
    hashes of the text, who is one of the id."""
    spans = F.struct(*(c.alias(k) for k, c in base_spans(F.col(text)).items()))
    every = docs.select(F.col(doc_id).alias("doc_id"), *_keys(text), _who(doc_id), F.col(text).alias("text"), spans.alias("spans"))
    some = F.expr(" or ".join(f"size(spans.{k}) > 0" for k in KINDS))
    return settle(every.select("doc_id", "t1", "t2", "who", "spans", F.when(some, _terms(F.col("text"))).alias("hs")), "spans")


def _who(doc_id: str) -> Column:
    return F.xxhash64(doc_id).alias("who")


def copies_of(spans: DataFrame) -> DataFrame:
    """(t1, t2, copies, who): the rows of each text, and one of them, settled."""
    return settle(spans.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("who").alias("who")), "copies")


def term_pairs(spans: DataFrame) -> DataFrame:
    """(entity, h, n_both, n_entity) by distinct texts: of the texts that mention the entity, and those that hold the term too."""
    tagged = F.concat(*(F.transform(F.col("spans").getField(k), lambda s: _entity(F.lit(k), s["value"])) for k in KINDS))  # noqa: B023
    mentions = spans.where("hs is not null").select("t1", "t2", F.array_distinct(F.transform(tagged, lambda e: F.xxhash64(e))).alias("entities"), "hs")
    mentions = settle(mentions.groupBy("t1", "t2").agg(F.first("entities").alias("entities"), F.first("hs").alias("hs")), "mentions")
    of_entity = mentions.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = mentions.select(F.explode("entities").alias("entity"), "hs").select("entity", F.explode("hs").alias("h")).groupBy("entity", "h").agg(F.count("*").alias("n_both"))
    return settle(pairs.join(of_entity, "entity"), "pairs")


def disclosing(docs: DataFrame, spans: DataFrame, copies: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(t1, t2, terms: array of struct(start, end)): the disclosing terms of each text that has any."""
    pairs = term_pairs(spans)
    texts = docs.select(*_keys(text), _who(doc_id), F.col(text).alias("text"))
    total = copies.count()
    # Each copy of a text counts for its part, so that a text counts once in all.
    repeated = settle(copies.where("copies > 1").select("t1", "t2", "copies"), "repeated")
    if repeated.count() <= FEW:
        repeated = F.broadcast(repeated)
    part = 1.0 / F.coalesce(F.col("copies"), F.lit(1))
    counted = texts.join(repeated, ["t1", "t2"], "left").select(part.alias("part"), F.explode(_terms(F.col("text"))).alias("h"))
    # Counted before the join, with a partial aggregate in each task: what is shuffled are distinct words.
    spread = settle(counted.groupBy("h").agg(F.round(F.sum("part")).cast("long").alias("n_term")), "spread")
    information = -F.log2(F.col("n_entity") / total)
    revealed = F.log2(F.col("n_both") * F.lit(float(total)) / ((F.col("n_entity") + 1) * (F.col("n_term") + 1)))
    telling = pairs.join(spread, "h").where((information > 0) & (revealed >= threshold * information)).select("h").distinct()
    telling = settle(telling, "telling")
    words = texts.select("t1", "t2", F.explode(_terms(F.col("text"))).alias("h"))
    if telling.count() <= FEW:
        telling = F.broadcast(telling)
    else:
        # Telling terms are rare: the commonest others, up to FEW of them, are kept out of the shuffle.
        words = words.join(F.broadcast(_commonest(spread, FEW).join(telling, "h", "left_anti")), "h", "left_anti")
    told = words.join(telling, "h").groupBy("t1", "t2").agg(F.collect_set("h").alias("told"))
    # One row of each text is read again; with its id in the key, copies do not meet in a task.
    told = settle(told.join(copies.select("t1", "t2", "who"), ["t1", "t2"]), "told")
    hits = texts.hint("merge").join(told.hint("merge"), ["t1", "t2", "who"]).dropDuplicates(["t1", "t2", "who"])
    places = _matches(F.col("text"), WORD, lambda w: F.array_contains("told", F.xxhash64(_term(w))))
    return settle(hits.select("t1", "t2", F.transform(places, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))).alias("terms")), "terms")


def _commonest(spread: DataFrame, most: int) -> DataFrame:
    """(h): at most `most` terms, those of the highest powers of two of n_term."""
    power = F.length(F.bin(F.greatest("n_term", F.lit(1))))
    sizes = dict(spread.groupBy(power.alias("k")).agg(F.count("*")).collect())  # at most 64 rows
    held, least = 0, 65
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > most:
            break
        least = k
    return spread.where(power >= least).select("h")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, t1, t2, spans, all: sorted array of struct(start, rank, end, kind)) for every row."""
    spans = found(docs, doc_id, text)
    copies = copies_of(spans)
    extra = disclosing(docs, spans, copies, doc_id, text, **how)
    joined = join_hot(spans.select("doc_id", "t1", "t2", "spans"), extra, ["t1", "t2"], copies, "copies", spans.count(), "left")

    def listed(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(_ORDER[kind]).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.array_sort(F.concat(*(listed(k, F.col("spans").getField(k)) for k in KINDS)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    outside = F.filter(F.coalesce("terms", none), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    every = F.array_sort(F.concat("base", listed("term", outside)))
    return joined.withColumn("base", base).withColumn("all", every).drop("terms")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with every span of its text generalised to its kind, as <EMAIL>; of overlapping spans the first, longest stays."""
    every, one, two = (fresh(df, f"sanitise_{c}") for c in ("all", "t1", "t2"))
    of_text = report(df, doc_id, text, **how).select(F.col("t1").alias(one), F.col("t2").alias(two), F.col("all").alias(every))
    of_text = of_text.where(F.size(every) > 0).dropDuplicates([one, two])
    keys = (F.xxhash64(text) == F.col(one)) & (F.xxhash64(F.lit(1), text, F.length(text)) == F.col(two))
    joined = df.join(of_text, keys, "left")

    def apart(state: Column, s: Column) -> Column:
        return F.when(s["start"] >= F.coalesce(F.try_element_at(state, F.lit(-1))["end"], F.lit(0)), F.concat(state, F.array(s))).otherwise(state)

    ordered = F.array_sort(every, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    spans = F.aggregate(ordered, F.slice(every, 1, 0), apart)

    def written_over(chars: Column, spans: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
            return F.concat(F.array_join(F.slice(chars, at + 1, s["start"] - at), ""), F.lit("<"), F.upper(s["kind"]), F.lit(">"))

        end = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(F.transform(spans, part), ""), F.array_join(F.slice(chars, end + 1, F.size(chars) - end), ""))

    # split("") gives the characters, with surrogate pairs kept together by the pattern.
    chars = F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))
    clean = F.when(F.size(every) > 0, let(chars, lambda c: let(spans, lambda s: written_over(c, s)))).otherwise(F.col(text))
    return joined.select(*(clean.alias(c) if c == text else F.col(c) for c in df.columns))
