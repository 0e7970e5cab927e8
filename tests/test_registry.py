"""Channels and keys, patches of three states, and sequences of candidates by plain union-find."""

import hashlib
import random

from pyspark.sql import functions as F

from spanwise.operators import channels, graph

CHANNELS = "channel_id long, channel_name string, user_id long, status string"
KEYS = "key_id long, channel_id long, key_hash string, user_id long, status string, role string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def test_a_second_channel_is_refused(spark):
    own = spark.createDataFrame([(1, "one", 10, "ACTIVE")], CHANNELS)
    keys = spark.createDataFrame([], KEYS)
    asks = spark.createDataFrame([(1, 10, 2, "two", 5, "a"), (2, 11, 3, "three", 6, "b"), (3, 11, 4, "four", 7, "c"), (4, 12, 5, "five", 8, "d")], "n long, user_id long, channel_id long, channel_name string, key_id long, plain string")
    after, kept, answers = channels.create(own, keys, asks, "n")
    assert {(r.n, r.verdict) for r in answers.collect()} == {(1, "has a channel"), (2, "created"), (3, "has a channel"), (4, "created")} and "plain" not in answers.columns
    assert {(r.channel_id, r.user_id) for r in after.collect()} == {(1, 10), (3, 11), (5, 12)}
    assert {tuple(r) for r in kept.collect()} == {(6, 3, sha("b"), 11, "ACTIVE", "USER"), (8, 5, sha("d"), 12, "ACTIVE", "USER")}
    again, same, answers = channels.create(after, kept, asks, "n")
    assert {r.verdict for r in answers.collect()} == {"has a channel"} and again.count() == 3 and same.count() == 2


def test_renewed_keys_and_names(spark):
    own = spark.createDataFrame([(1, "one", 10, "ACTIVE"), (2, "two", 11, "ACTIVE"), (3, "three", 12, "ACTIVE")], CHANNELS)
    keys = spark.createDataFrame([(7, 1, "x", 10, "REVOKED", "USER"), (5, 1, "y", 10, "ACTIVE", "USER"), (9, 3, "z", 12, "ACTIVE", "USER")], KEYS)
    asks = spark.createDataFrame([(1, "", 70, "p1"), (2, "new", 71, "p2"), (3, None, 72, None), (4, "no", 73, "p4")], "channel_id long, new_name string, key_id long, plain string")
    after, kept, answers = channels.renew(own, keys, asks)
    assert {(r.channel_id, r.channel_name) for r in after.collect()} == {(1, "one"), (2, "new"), (3, "three")}
    assert {(r.key_id, r.channel_id, r.key_hash, r.status) for r in kept.collect()} == {(7, 1, "x", "REVOKED"), (5, 1, sha("p1"), "ACTIVE"), (9, 3, "z", "ACTIVE"), (71, 2, sha("p2"), "ACTIVE")}
    assert {(r.channel_id, r.verdict) for r in answers.collect()} == {(1, "changed"), (2, "changed"), (3, "changed"), (4, "no such channel")}


def test_a_first_admin_key_once(spark):
    keys = spark.createDataFrame([(1, None, "x", 10, "ACTIVE", "ADMIN"), (2, None, "y", 11, "REVOKED", "ADMIN")], KEYS)
    users = spark.createDataFrame([(10, "ADMIN"), (11, "ADMIN"), (12, "USER")], "user_id long, role string")
    asks = spark.createDataFrame([(1, 10, 5, "a"), (2, 11, 6, "b"), (3, 11, 7, "c"), (4, 12, 8, "d"), (5, 13, 9, "e")], "n long, user_id long, key_id long, plain string")
    kept, answers = channels.first_admin_keys(keys, users, asks, "n")
    assert {(r.n, r.verdict) for r in answers.collect()} == {(1, "has a key"), (2, "created"), (3, "has a key"), (4, "no admin"), (5, "no admin")}
    assert [(r.key_id, r.key_hash, r.role) for r in kept.where("key_id > 2").collect()] == [(6, sha("b"), "ADMIN")]


def test_patch_sets_named_nulls_only(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id long, name string, size long")
    changes = spark.createDataFrame([(1, ["name"], None, 9), (2, ["size", "name"], "x", None), (4, ["name"], "y", 1)], "id long, given array<string>, name string, size long")
    assert {tuple(r) for r in channels.patch(old, changes, "id").collect()} == {(1, None, 1), (2, "x", None), (3, "c", 3)}
    assert {tuple(r) for r in channels.patch(old, changes.drop("size"), "id").collect()} == {(1, None, 1), (2, "x", 2), (3, "c", 3)}


def plain_sequences(rows, edges):
    """rows: key, start, chunk, candidate, from_chunk, from_candidate."""
    place = {(r[2], r[3]): r[0] for r in rows}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))

    for key, _, chunk, _, fc, fp in rows:
        if fp is None or edges is not None and (fc or 0) != chunk:
            continue
        join(key, place.get((chunk, fp), None if edges is not None else place.get((fc or 0, fp))))
    for kind, a, b, c, d in edges or []:
        if kind == "continuous":
            join(place.get((a or 0, b or 0)), place.get((c or 0, d or 0)))
    first = {}
    for r in rows:
        first[find(r[0])] = min(first.get(find(r[0]), r[1]), r[1])
    number = {r: i for i, r in enumerate(sorted(first, key=lambda r: (first[r], r)))}
    return {r[0]: number[find(r[0])] for r in rows}


def test_sequences(spark):
    rnd = random.Random(5)
    shape = "source_id long, key long, start_ms long, chunk_index long, candidate_index long, from_chunk long, from_candidate long"
    kinds = "source_id long, type string, from_chunk long, from_candidate long, to_chunk long, to_candidate long"
    rows, edges = [], []
    for s in range(12):
        for i in range(rnd.randint(1, 40)):
            rows.append((s, s * 1000 + i, rnd.randrange(10_000), i // 6, i % 6, rnd.choice([None, i // 6, i // 6 - 1, 9]), rnd.choice([None, None, i % 6 - 1, 0, 7])))
        edges += [(s, rnd.choice(["continuous", "contrast"]), *(rnd.choice([None, 0, 1, 2, 5]) for _ in range(4))) for _ in range(6)]
    frame = spark.createDataFrame(rows, shape)
    for given in (None, [], edges):
        links = None if given is None else spark.createDataFrame(given, kinds)
        got = {r.key: r.sequence_id for r in graph.sequences(frame, ["source_id"], "key", "start_ms", links).collect()}
        want = {}
        for s in range(12):
            own = [r[1:] for r in rows if r[0] == s]
            want |= plain_sequences(own, None if given is None else [e[1:] for e in given if e[0] == s])
        assert got == want


def test_a_hot_component(spark):
    """One row that thousands continue, and a chain as long."""
    star = spark.range(1, 3000).select(F.lit(1).alias("source_id"), F.col("id").alias("key"), F.col("id").alias("start_ms"), F.lit(0).alias("chunk_index"), F.col("id").alias("candidate_index"), F.lit(0).alias("from_chunk"), F.when(F.col("id") > 1, F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") - 1)).alias("from_candidate"))
    assert [tuple(r) for r in graph.sequences(star, ["source_id"], "key", "start_ms").groupBy("sequence_id").count().collect()] == [(0, 2999)]
