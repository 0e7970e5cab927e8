import collections
import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.llm import common, pii, url_filters

from .data import frame

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


TRICKY = [
    "mail a@b.com_c@d.org now", "aa@bb@cc.com", "x@y", "🙂 é a.b+c@d-e.co.uk. 1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567, +12", "call +49.30.1234567 4111111111111111", "1.2.3.4" * 50,
    "9" * 5000, "a" * 5000 + "@", ".a" * 3000 + "@x" + ".y" * 3000, "1 " * 4000, "+1" + "(" * 2000, None, "",
]


def test_base_spans(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TRICKY)]
    got = {r.doc_id: r.s for r in pii.report(frame(spark, rows)).select("doc_id", pii.written(F.col("base")).alias("s")).collect()}
    for i, t in enumerate(TRICKY):
        assert got[i] == brute(t), (i, (t or "")[:60])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a1@.+- ()é🙂_%59", max_size=60), min_size=40, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.s for r in pii.found(frame(spark, rows)).select("doc_id", F.array_join(F.transform("spans.email", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{m.start()}:{m.end()}" for m in re.finditer(PATTERNS["email"], t))


def test_disclosing_terms(spark):
    """A rare name beside the same address in several texts discloses it; common words do not."""
    rows = [(i, f"report {i} filed today by Zoltan at boss@corp.example for the team number {i}", None, None, None) for i in range(5)]
    rows += [(100 + i, f"report about the team number {i} filed today by us at work for nobody at all", None, None, None) for i in range(200)]
    rows += [(400 + i, "the lone Quixote wrote from one@copy.example today", None, None, None) for i in range(9)]
    out = {r.doc_id: r for r in pii.report(frame(spark, rows)).select("doc_id", pii.written(F.col("all")).alias("s")).collect()}
    at = rows[0][1].index("Zoltan")
    assert f"term:{at}:{at + 6}" in out[0].s and out[0].s.count("term") == 1
    assert out[100].s == "" and "term" not in out[400].s  # copies prove nothing
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[0] == "report 0 filed today by <TERM> at <EMAIL> for the team number 0" and clean[100] == rows[5][1]


def test_disclosing_terms_of_one_text(spark):
    """A name seen once with an address discloses it, however far from it, and goes in other texts too."""
    filler = " ".join(["report about the team number filed today for nobody at all"] * 20)
    rows = [(0, f"Zoltan said so. {filler} one@far.example", None, None, None), (1, "the team asked Zoltan, about nobody", None, None, None)]
    rows += [(100 + i, f"report about the team number {i} filed today for nobody at all", None, None, None) for i in range(3000)]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert clean[0].startswith("<TERM> ") and clean[0].endswith("all <EMAIL>")
    assert clean[1] == "the team asked <TERM> about nobody" and clean[100] == rows[2][1]


def test_terms_of_any_length(spark):
    """Names of one or two letters disclose as longer ones do."""
    filler = "report about the team number filed today for nobody at all"
    for name in ("zq", "Q", "李", "王芳", "zqw"):
        rows = [(i, f"{filler} {name} wrote from one@far.example, take {i}", None, None, None) for i in range(12)]
        rows += [(100 + i, f"{filler} x{i}", None, None, None) for i in range(2000)]
        out = {r.doc_id: r.s for r in pii.report(frame(spark, rows)).select("doc_id", pii.written(F.col("all")).alias("s")).collect()}
        at = len(filler) + 1
        assert f"term:{at}:{at + len(name)}" in out[0] and out[100] == ""


def test_copies_do_not_hide_a_term(spark):
    """A text with a telling term may have any number of copies."""
    rows = [(i, f"report {min(i, 4)} filed today by Zoltan at boss@corp.example", None, None, None) for i in range(200)]
    rows += [(1000 + i, f"report about the team number {i} filed today", None, None, None) for i in range(400)]
    out = {r.doc_id: r.s for r in pii.report(frame(spark, rows)).select("doc_id", pii.written(F.col("all")).alias("s")).collect()}
    at = rows[0][1].index("Zoltan")
    assert all(f"term:{at}:{at + 6}" in out[i] for i in range(200))


def brute_all(rows, threshold=0.75):
    """doc_id -> all spans, by the definitions: mutual information over distinct texts, every standing of a telling term."""
    term = lambda w: "".join(c for c in w if c.isalnum()).lower()
    words = lambda t: [(m.start(), m.end(), term(m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
    texts = {t for _, t, *_ in rows}
    terms = {t: {w for _, _, w in words(t) if w} for t in texts}
    mentions = {}
    for t in texts:
        for kind, pattern in PATTERNS.items():
            for m in re.finditer(pattern, t or ""):
                if valid(kind, m[0]):
                    mentions.setdefault(t, set()).add((kind, re.sub("[^0-9]", "", m[0]) if kind in ("card", "phone") else m[0].lower()))
    of_term, of_entity, both = collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        of_term.update(terms[t])
        of_entity.update(mentions.get(t, ()))
        both.update((e, w) for e in mentions.get(t, ()) for w in terms[t])
    told = set()
    for (e, w), n in both.items():
        information = -math.log2(of_entity[e] / len(texts))
        if information > 0 and math.log2(n * len(texts) / ((of_entity[e] + 1) * (of_term[w] + 1))) >= threshold * information:
            told.add(w)
    out = []
    for i, t, *_ in rows:
        base = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if valid(k, m[0])]
        spans = base + [(a, 4, z, "term") for a, z, w in words(t) if w in told and not any(s < z and a < e for s, _, e, _ in base)]
        out.append((i, ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))))
    return out, told


@pytest.mark.parametrize("few, hot", [(10**6, 1000), (20, 4), (0, 10**9)])
def test_spans_against_brute_force(spark, monkeypatch, few, hot):
    """Whether telling terms and copies are joined by broadcasts or by shuffles, and texts hot or not."""
    monkeypatch.setattr(pii, "FEW", few)
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rnd = random.Random(9)
    common_words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = [rnd.choice(common_words) for _ in range(rnd.randint(3, 40))]
        if i % 4 == 0:
            words.insert(rnd.randrange(len(words)), rnd.choice(["x@y.org", "(Anna@b.com)", f"u{i}@c.net", "+49 30 1234567", f"10.0.{i % 7}.{i % 250}"]))
            words.insert(rnd.randrange(len(words)), rnd.choice(["Zoltán,", f"Name{i}", "QUIXOTE", "quixote!"]))
        rows.append((i, " ".join(words), None, None, None))
    rows += [(1000 + i, rows[rnd.choice([0, 4, 8])][1], None, None, None) for i in range(60)]
    rows += [(2000, None, None, None, None), (None, rows[0][1], None, None, None), (4, rows[0][1], None, None, None), (4, rows[0][1], None, None, None), (2001, "", None, None, None)]
    want, told = brute_all(rows)
    assert len(told) > 30
    got = [tuple(r) for r in pii.report(frame(spark, rows)).select("doc_id", pii.written(F.col("all")).alias("s")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pii_edges(spark):
    assert pii.report(frame(spark, empty=True)).count() == 0
    rows = [(None, None, None, None, None), (1, "🙂 a@b.c", None, None, None), (1, "🙂 a@b.c", None, None, None)]
    clash = frame(spark, rows).withColumns({c: F.lit(1) for c in ("all", "t1", "t2", "who", "spans", "hs", "base", "sanitise_all")})
    out = pii.sanitise(clash)
    assert out.columns == clash.columns and sorted(str(r.text) for r in out.collect()) == ["None", "🙂 <EMAIL>", "🙂 <EMAIL>"]
    long = "Quixote " + "word " * 30_000 + "q@long.example"
    got = pii.report(frame(spark, [(1, long, None, None, None), *((i, f"word {i}", None, None, None) for i in range(2, 400))])).where("doc_id = 1").select(pii.written(F.col("all"))).first()[0]
    assert got == f"term:0:7,email:{len(long) - 14}:{len(long)}"
    assert hashlib.sha256(b"").hexdigest() == pii.report(frame(spark, rows)).where("doc_id is null").select(F.sha2(pii.written(F.col("base")), 256)).first()[0]


def judge_rule(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r, _ in url_filters.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


URLS = ["http://A.Example.com/en/7x?a=1", "https://example.com/en/8", "x.net/de/", "ftp://net/de/9#f", "https://a.example.net/de/80", "https://notcom/en/", None, "", "://", "http://xcom/en/", "http://É.org/es/?q", "a\nb://c.org/es/\nx"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"http://h{i % 9}.example.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/{i}") for i in range(80)]
    out, names = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"))
    got = {r.page_id: r for r in out.collect()}
    verdicts = dict(url_filters.RULES)
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, rule = judge_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdicts[rule] if rule else got[i].verdict in ("allow", "block")


def test_url_trees_learn(spark):
    """URLs that no rule decides follow labelled ones that look like them."""
    rows = [(i, f"http://good{i % 5}.example.net/de/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://cheap-win-{i}.spam.com/en/buy?id={i}&ref=x&s={i * 37}") for i in range(300)]
    rows += [(2000 + i, f"http://cheap-win-{i}.spam.com/shop/buy?id={i}&ref=x&s={i * 37}") for i in range(50)]
    rows += [(3000 + i, f"http://good{i % 5}.example.net/at/{i}") for i in range(50)]
    out, names = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"))
    got = {r.page_id: r.verdict for r in out.collect()}
    assert sum(got[2000 + i] == "block" for i in range(50)) >= 45 and sum(got[3000 + i] == "allow" for i in range(50)) >= 45


def test_url_suffixes_of_all_labelled(spark, monkeypatch):
    """The suffix shares cover every labelled URL, not only the sample that the trees are fitted on."""
    rows = [(i, f"http://a.h{i}.{'com/en' if i % 2 else 'net/de'}/{i}") for i in range(200)]
    made, settle = [], url_filters.settle
    monkeypatch.setattr(url_filters, "settle", lambda df, what: made.append((what, settle(df, what))) or made[-1][1])
    url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), max_train=60)
    assert [df.count() for what, df in made if what == "suffixes"] == [2, 200]


def test_a_common_url_is_one_row_of_the_sample(spark, monkeypatch):
    rows = [(i, "http://same.com/en/1" if i % 2 else f"http://h{i}.example.net/de/{i % 200}") for i in range(1200)]
    made, settle = [], url_filters.settle
    monkeypatch.setattr(url_filters, "settle", lambda df, what: made.append((what, settle(df, what))) or made[-1][1])
    out, _ = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"))
    sample = next(df for what, df in made if what == "urls")
    assert sample.where("host = 'same.com'").select("url", "weight").collect() == [("http://same.com/en/1", 600.0)]
    assert {r.verdict for r in out.where("host = 'same.com'").collect()} == {"block"}


def test_url_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.judge(empty)[0].count() == 0
    one = spark.createDataFrame([(1, "http://a.com/en/"), (2, "nothing"), (2, "nothing")], "page_id long, url string").withColumn("host", F.lit("mine"))
    out, names = url_filters.judge(one)
    assert names["host"] != "host" and {r.page_id: r.verdict for r in out.collect()} == {1: "block", 2: "block"}
