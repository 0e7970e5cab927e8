"""Queries over small tables of odd rows, which DuckDB's answer to their SQL must equal."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from spanwise.functions import transcripts
from spanwise.operators import quotes
from spanwise.queries import ORACLE, QUERIES

from .test_queries import rows


def agrees(spark, folder, name, **tables) -> None:
    con = duckdb.connect()
    for table, values in tables.items():
        con.execute(f"create table {table} as {values}")
        con.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert (got := rows(df.columns, df.collect())) == rows(names, want.fetchall())
    assert got


def events(values: str) -> str:
    return f"select n::bigint as event_id, timestamp '2024-01-01' + to_milliseconds(ms) as ts, 1::bigint as user_id, kind as event_type, value::double as value, '{{}}' as props from (values {values}) as t(n, ms, kind, value)"


def turns(texts: list[str]) -> str:
    values = ", ".join("(1::bigint, {}::bigint, 'user', '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(texts))
    return f"select * from (values {values}) as t(conv_id, turn, role, text)"


def test_iou_pairs_with_moments_of_no_length(spark, tmp_path):
    # The second lies within the first without a length; the third touches the first's start, the fourth has the second's time.
    agrees(spark, tmp_path, "event_iou_pairs", events=events("(1, 1000, 'view', 0.01), (2, 3000, 'view', 0), (3, 1000, 'view', 0), (4, 3000, 'view', 0), (5, 4000, 'click', 0.02)"))


def test_shorten_with_blanks_at_the_ends(spark, tmp_path):
    # Turn i may keep 10 + i characters, half of them by the shortener: a line break or a tab there stays, a blank does not, and a text
    # that the shortener gives back is cut, even one with blanks around it.
    texts = ["Abcd\nefghijklmno", "Abcd efghij klmno", "abcde\tghi klmnop", " bcd\nefghijklmnopq\n", "\n\n\n\n\n\n\n\n\nijklmno", "          klmnop", "\nab., cdefghijklmn ", "short"]
    agrees(spark, tmp_path, "hook_shorten", conversations=turns(texts + [f" {'a b' * k}\n" for k in range(8, 16)]))


def test_error_rate_of_whole_thousandths(spark, tmp_path):
    # 8 of 1 is 8000; 203 edits of 25 characters are 8120, of which 203 / 25 * 1000 falls short.
    agrees(spark, tmp_path, "turn_error_rate", conversations=turns(["a" * 25, "b" * 203, "", "ab", "a" * 125, "b" * 289]))


def test_passages_of_every_length_are_found_at_every_place(spark):
    text = "".join(chr(97 + (i * i * 7 + i * 3 + i // 5) % 26) for i in range(9000)) + "z" * 130
    needles = [(1000 * size + at, text[at : at + size]) for size in (10, 18, 19, 38, 39, 78, 79, 120) for at in (0, 1, 7, 39, 4090, 4096, 8999 - size, 9129 - size)]
    texts = spark.createDataFrame([(1, text), (2, text[5:200]), (3, "short")], "doc_id long, n string")
    got = quotes.occurrences(texts, spark.createDataFrame(needles, "k long, needle string"), ["doc_id"]).select("doc_id", "k", "at").collect()
    want = [(d, k, at) for d, n in ((1, text), (2, text[5:200])) for k, x in needles for at in range(len(n)) if n.startswith(x, at)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_passages(spark):
    texts = spark.createDataFrame([(1, "abcdefghijklmno")], "doc_id long, n string")
    assert quotes.occurrences(texts, spark.createDataFrame([(1, "short")], "k long, needle string"), ["doc_id"]).collect() == []


def test_notation_of_rules_of_several_tokens(spark):
    df = spark.createDataFrame([("a b c a b a d",), ("b a",), (None,), ("",)], "text string")
    got = [r.r for r in df.select(transcripts.restore_notation(F.col("text"), {"a": "1", "a b": "2", "b c": "3"}).alias("r")).collect()]
    assert [None if r is None else (r.text, list(r.used)) for r in got] == [("2 c 2 1 d", ["a b→2", "a b→2", "a→1"]), ("b 1", ["a→1"]), None, ("", [])]
