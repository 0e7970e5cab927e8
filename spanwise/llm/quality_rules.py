"""Quality rules: weak supervision over heuristics that vote or abstain.

Every rule looks at counts of one text and votes 1 (good), -1 (bad) or 0 (abstains). A label model
(two latent classes; each rule has its own chance of a bad vote in either class) is fitted by
expectation-maximisation on the counts of vote patterns. There are at most 3**len(RULES) patterns, so
what reaches the driver does not grow with the corpus, and the fit still uses every document. The
posterior probability of the good class, not a demand that all rules pass, decides.

Defined results: null and empty texts have no words, fail the base checks and are not kept; ties,
repeated rows and null ids are judged row by row; an empty table gives an empty result; columns of
the input pass through under their names, new ones avoid them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches
from .textblock import WORD_BASE, Block, all_blocks, mixed, per_doc, span_hashes

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_letters", "n_upper", "n_alpha_words", "n_shouts", "n_marked_words",
)
KIND = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_HEAD = _table(bytes(x for x in range(256) if x & 0xC0 != 0x80))


def _repeated_in_doc(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether its document has it more than once, whether it had it earlier."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    joint = mixed(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(joint, kind="stable")
    same = joint[order][1:] == joint[order][:-1]
    often, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order[1:]] |= same
    often[order[:-1]] |= same
    later[order[1:]] = same
    return often, later


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    b = Block(texts)
    word_doc, hashes = b.word_doc(), b.word_hashes()
    starts, windows = b.windows(hashes, 3, WORD_BASE)
    often, _ = _repeated_in_doc(windows, word_doc[starts])
    inside = np.zeros(len(hashes), bool)
    for k in range(3):
        inside[starts[often] + k] = True
    line_from, line_to, line_doc = b.line_spans()
    has_word = np.searchsorted(b.starts, line_to) > np.searchsorted(b.starts, line_from)
    lines = span_hashes(b.bytes.astype(np.uint64) + np.uint64(1), line_from[has_word], line_to[has_word], WORD_BASE)
    _, line_later = _repeated_in_doc(lines, line_doc[has_word])
    dup = np.bincount(line_doc[has_word][line_later], minlength=b.n)
    _, word_later = _repeated_in_doc(hashes, word_doc)
    letters = np.concatenate([[0], np.cumsum(_LETTER[b.bytes])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[b.bytes])])
    return {
        "n_words": np.diff(b.word_at),
        "word_chars": per_doc(_HEAD[b.bytes] & ~b.blank, b.doc_at),
        "n_symbols": per_doc(_SYMBOL[b.bytes], b.doc_at),
        "n_dup_lines": dup,
        "n_repeat_words": per_doc(inside, b.word_at),
        "n_lines": np.bincount(line_doc[has_word], minlength=b.n),
        "n_distinct": per_doc(~word_later, b.word_at),
        "n_letters": per_doc(_LETTER[b.bytes], b.doc_at),
        "n_upper": per_doc(_UPPER[b.bytes], b.doc_at),
        "n_alpha_words": per_doc(letters[b.ends] > letters[b.starts], b.word_at),
        "n_shouts": per_doc(b.bytes == 33, b.doc_at),
        "n_marked_words": per_doc(symbols[b.ends] > symbols[b.starts], b.word_at),
    }


def counted(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df with a struct of COUNTS, and the struct's name. One pass, no shuffle."""
    name = fresh(df, "quality_counts")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in all_blocks(batches, text):
            got = count(part.column(text))
            stats = pa.StructArray.from_arrays([pa.array(got[c].astype(np.int64)) for c in COUNTS], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*part.columns, stats], names=[*part.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, KIND)])), name


@dataclass(frozen=True)
class Rule:
    """SQL conditions over COUNTS for a bad and a good vote; neither: it abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("shouting", "2 * n_upper > n_letters", "10 * n_upper <= n_letters"),
    Rule("exclamations", "4 * n_shouts > n_words", "20 * n_shouts <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    Rule("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 4 * n_words and 7 * n_words"),
    Rule("line_copies", "100 * n_dup_lines > 30 * n_lines", "n_dup_lines = 0 and n_lines >= 3"),
    Rule("distinct_words", "n_words >= 50 and 100 * n_distinct < 15 * n_words", "100 * n_distinct >= 40 * n_words"),
    Rule("marked_words", "100 * n_marked_words > 30 * n_words", "100 * n_marked_words <= 2 * n_words"),
    Rule("letters", "100 * n_letters < 80 * word_chars", "100 * n_letters >= 90 * word_chars"),
    Rule("alphabetic", "100 * n_alpha_words < 70 * n_words", "100 * n_alpha_words >= 90 * n_words"),
)
#: What a document must pass before any model is asked.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def _over(condition: str, counts: str) -> Column:
    return F.expr("".join(f"`{counts}`.{w}" if w in COUNTS else w for w in _split_names(condition)))


def _split_names(condition: str) -> list[str]:
    import re

    return re.split(r"(\b[a-z_]+\b)", condition)


def votes(counts: str, rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.when(_over(r.bad, counts), -1).when(_over(r.good, counts), 1).otherwise(0).alias(f"vote_{r.name}") for r in rules]


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; bad_in_good, bad_in_bad: each rule's chance of voting bad when it votes."""

    prior: float
    bad_in_good: tuple[float, ...]
    bad_in_bad: tuple[float, ...]

    def posterior(self, counts: str, rules: tuple[Rule, ...] = RULES) -> Column:
        """Probability of the good class, as a SQL expression."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, g, b in zip(votes(counts, rules), self.bad_in_good, self.bad_in_bad, strict=True):
            total = total + F.when(vote == -1, math.log(g / b)).when(vote == 1, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents have each.

    Beta priors (worth 20 votes) hold the classes to their meaning, so that neither an empty table nor
    a corpus without bad documents swaps or merges them."""
    k = patterns.shape[1] if patterns.ndim == 2 else len(RULES)
    patterns = patterns.reshape(-1, k)
    is_bad, is_good = patterns == -1, patterns == 1
    prior, g, b = 0.8, np.full(k, 0.02), np.full(k, 0.4)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + is_bad @ np.log(g / b) + is_good @ np.log((1 - g) / (1 - b))
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        good, bad = weights * p, weights * (1 - p)
        prior = (good.sum() + 16) / (weights.sum() + 20)
        g = (good @ is_bad + 0.4) / (good @ (is_bad | is_good) + 20)
        b = np.maximum((bad @ is_bad + 8) / (bad @ (is_bad | is_good) + 20), g)
        g, b = np.clip(g, 1e-4, 0.05), np.clip(b, 0.1, 0.98)
    return LabelModel(float(prior), tuple(map(float, g)), tuple(map(float, b)))


def learn(with_counts: DataFrame, counts: str, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The label model of all documents that pass the base checks."""
    judged = with_counts.where(~_over(BASE_FAILED, counts)).select(*votes(counts, rules))
    rows = judged.groupBy(*judged.columns).agg(F.count("*").alias("n")).collect()  # at most 3**len(rules)
    return fit(np.array([r[:-1] for r in rows]), np.array([r[-1] for r in rows], float))


def judged(with_counts: DataFrame, counts: str, model: LabelModel, least: float = 0.5) -> tuple[Column, Column, Column]:
    """base_failed, the posterior, and whether a document is kept."""
    failed, posterior = _over(BASE_FAILED, counts), model.posterior(counts)
    return failed, posterior, ~failed & (posterior >= least)


def keep(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose quality posterior is at least `least`; columns as before."""
    learned, name = counted(df.select(text), text)
    model = learn(learned, name)
    scored, name = counted(df, text)
    return scored.where(judged(scored, name, model, least)[2]).drop(name)
