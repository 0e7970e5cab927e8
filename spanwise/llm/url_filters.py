"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits decides. URLs
that a rule decides are the labelled ones: trees are fitted on a bounded sample of them (about MAX_TRAIN
different URLs, chosen by hash and weighted by their rows) and give every other URL a probability of being blocked. Features are computed
in SQL from the text of the URL alone: lengths, depth, shares of digits and marks, entropy of its
characters, parameter counts, and for its host suffixes the blocked share among all labelled URLs. That
table has one row a suffix, and is joined; only the trees' fit uses the sample.

Defined results: null URLs and URLs without :// have an empty host and path and no rule; the trees
judge them too; repeated rows get equal verdicts; without labelled URLs of both classes the verdict of
the rest is the class that there is, or "allow"; an empty table gives none. Columns pass through.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle

#: (rule, verdict); a rule is a host, a slash and the rest of a path prefix.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
MAX_TRAIN, TREES, DEPTH, SMOOTH = 20_000, 20, 4, 10.0
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(found, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(found, _PARTS, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of a URL, doubles."""
    text = F.coalesce(url, F.lit(""))
    size = F.length(text)
    count = lambda col, what: F.regexp_count(col, F.lit(what))
    characters = F.filter(F.split(text, ""), lambda c: c != "")
    distinct = F.array_distinct(characters)
    each = F.transform(distinct, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    entropy = F.aggregate(each, F.lit(0.0), lambda a, n: a - F.when(n > 0, n / size * F.log2(n / size)).otherwise(0.0))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    made = {
        "length": size,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/[^/]"),
        "labels": F.when(host == "", 0).otherwise(count(host, r"\.") + 1),
        "digit_share": _share(count(text, "[0-9]"), size),
        "host_digit_share": _share(count(host, "[0-9]"), F.length(host)),
        "mark_share": _share(count(text, "[^A-Za-z0-9]"), size),
        "hyphens": count(host, "-"),
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "query_length": F.length(query),
        "fragment": text.contains("#"),
        "secure": text.startswith("https"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)),
        "longest_step": F.coalesce(F.array_max(F.transform(F.split(path, "/"), F.length)), F.lit(0)),
        "last_step_digits": count(F.substring_index(path, "/", -1), "[0-9]"),
    }
    return {k: v.cast("double") for k, v in made.items()}


def _suffixes(host: Column) -> dict[str, Column]:
    return {f"last_{n}": F.substring_index(host, ".", -n) for n in (1, 2)}


def judge(df: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, max_train: int = MAX_TRAIN) -> tuple[DataFrame, dict[str, str]]:
    """df with host, path, rule, verdict and score (chance of block; null where a rule decides), and the new columns' names."""
    names = {c: fresh(df, c) for c in ("host", "path", "rule", "verdict", "score")}
    host, path = host_and_path(F.col(url))
    base = df.withColumns({names["host"]: host, names["path"]: path})
    base = base.withColumn(names["rule"], rule_of(F.col(names["host"]), F.col(names["path"]), rules))
    blocked = F.col(names["rule"]).isin(*[r for r, v in rules if v == "block"] or [""])
    slim = base.select(F.col(url).alias("url"), F.col(names["host"]).alias("host"), F.col(names["path"]).alias("path"), F.col(names["rule"]).isNotNull().alias("ruled"), blocked.cast("double").alias("label"))
    labelled = slim.where("ruled")
    total, ones = labelled.agg(F.count("*"), F.sum("label")).first()
    by_rule = F.when(F.col(names["rule"]).isNull(), None).when(blocked, "block").otherwise("allow")
    if not total or ones in (0, total):
        rest = "block" if total and ones == total else "allow"
        score = F.when(F.col(names["rule"]).isNull(), 1.0 if rest == "block" else 0.0)
        return base.withColumns({names["verdict"]: F.coalesce(by_rule, F.lit(rest)), names["score"]: score}), names

    # Every URL's place in the hash order is fixed, so the sample does not depend on how the table is cut. A URL is one row of
    # it, weighted by how often it occurs, so that a very common one does not fill it.
    chosen = F.pmod(F.xxhash64("url", F.lit(7)), F.lit(total)) < max_train
    once = labelled.where(chosen).groupBy("url", "host", "path", "ruled", "label").agg(F.count("*").cast("double").alias("weight"))
    sample = settle(once.select("*", *(c.alias(k) for k, c in features(F.col("url"), F.col("host"), F.col("path")).items())), "urls")
    overall = ones / total
    suffixes = {}
    for name, suffix in _suffixes(F.col("host")).items():
        grouped = labelled.groupBy(suffix.alias(name)).agg(((F.sum("label") + SMOOTH * overall) / (F.count("*") + SMOOTH)).alias(f"{name}_rate"))
        suffixes[name] = settle(grouped, "suffixes")

    def with_suffixes(rows: DataFrame, of: Column) -> DataFrame:
        for name, rates in suffixes.items():
            rows = rows.join(rates.withColumnRenamed(name, f"{name}_key"), _suffixes(of)[name] == F.col(f"{name}_key"), "left").drop(f"{name}_key")
            rows = rows.fillna({f"{name}_rate": overall})
        return rows

    inputs = [*features(F.col("url"), F.col("host"), F.col("path")), *(f"{n}_rate" for n in suffixes)]
    vectors = VectorAssembler(inputCols=inputs, outputCol="features")
    trainable = vectors.transform(with_suffixes(sample, F.col("host"))).select("label", "features", "weight")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, weightCol="weight").fit(trainable)

    # The trees see only URLs that no rule decides; a URL's features depend on nothing else.
    rest = base.where(F.col(names["rule"]).isNull())
    open_ = rest.select(F.struct(*(F.col(f"`{c}`") for c in rest.columns)).alias("row"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(names["host"]).alias("host"), F.col(names["path"]).alias("path"))
    open_ = open_.select("*", *(c.alias(k) for k, c in features(F.col("url"), F.col("host"), F.col("path")).items()))
    scored = model.transform(vectors.transform(with_suffixes(open_, F.col("host")))).withColumn("p", vector_to_array("probability")[1])
    scored = scored.select(*(F.col("row").getField(c).alias(c) for c in rest.columns), F.when(F.col("p") >= 0.5, "block").otherwise("allow").alias(names["verdict"]), F.col("p").alias(names["score"]))
    sure = base.where(F.col(names["rule"]).isNotNull()).withColumns({names["verdict"]: by_rule, names["score"]: F.lit(None).cast("double")})
    return sure.unionByName(scored), names
