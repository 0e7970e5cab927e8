"""Changes to keyed tables as joins: inserts that respect a key, partial updates, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_new(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with the rows of new whose key it does not have."""
    return old.unionByName(new.join(old.select(*key).distinct(), list(key), "left_anti").select(*old.columns))


def update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the values of changes where they are not null; one change a key."""
    others = [c for c in old.columns if c != key]
    joined = old.join(changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in others)), key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in others else F.col(c) for c in old.columns))


def upsert(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """update(), and the changes whose key is new."""
    return update(old, changes, key).unionByName(changes.join(old.select(key), key, "left_anti").select(*old.columns))


def cascade(children: DataFrame, parents: DataFrame, key: str, status: str, parent_status: str) -> DataFrame:
    """children with their parent's status where it has one."""
    joined = children.join(parents.select(key, F.col(parent_status).alias("_status")), key)
    return joined.withColumn(status, F.coalesce("_status", status)).drop("_status")


def last_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def restore(rows: DataFrame, known: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """rows with the fields of the known row of their key; without one they stay as they are."""
    joined = rows.join(known.select(*key, *(F.col(c).alias(f"_known_{c}") for c in fields)), list(key), "left")
    return joined.select(*(F.coalesce(f"_known_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def first_of(rows: DataFrame, key: str, value: object, order: str) -> DataFrame:
    """At most one row with a key's value, the first in order."""
    return rows.where(F.col(key) == value).orderBy(order).limit(1)


def allowed_channel(requests: DataFrame, keys: DataFrame, key: str = "key_hash") -> DataFrame:
    """requests with channel and verdict: an admin's key may name any channel, a user's only its own; without one it is
    that. Unknown or inactive keys are refused. keys: key_hash, role, own, status."""
    joined = requests.join(keys.select(key, "role", "own", "status"), key, "left")
    verdict = (
        F.when(F.col("role").isNull(), "unknown key").when(F.col("status") != "ACTIVE", "inactive key")
        .when((F.col("role") != "ADMIN") & F.col("wanted").isNotNull() & (F.col("wanted") != F.col("own")), "not its channel").otherwise("ok")
    )
    return joined.withColumns({"verdict": verdict, "channel": F.when(verdict == "ok", F.coalesce("wanted", "own"))}).drop("role", "own", "status")


def key_hashes(keys: DataFrame, plain: str = "plain", key: str = "key_hash") -> DataFrame:
    """Keys as their SHA-256; the plain ones go."""
    return keys.withColumn(key, F.sha2(plain, 256)).drop(plain)


def patch(old: DataFrame, changes: DataFrame, key: str, given: str = "given") -> DataFrame:
    """old with the fields that a change names in the array `given`, whatever they are: a named null is set, what is not named stays.
    One change a key; changes: key, given and the fields."""
    others = [c for c in old.columns if c != key]
    told = changes.select(key, F.col(given).alias("_given"), *(F.col(c).alias(f"_new_{c}") for c in others if c in changes.columns))
    joined = old.join(told, key, "left")
    named = lambda c: F.coalesce(F.array_contains("_given", c), F.lit(False))
    return joined.select(*(F.when(named(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if f"_new_{c}" in joined.columns else F.col(c) for c in old.columns))


CHANNEL, KEY = ("channel_id", "channel_name", "user_id", "status"), ("key_id", "channel_id", "key_hash", "user_id", "status", "role")


def create(channels: DataFrame, keys: DataFrame, requests: DataFrame, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, keys, answers) after requests (order, user_id, channel_id, channel_name, key_id, plain): a user without a channel gets one
    and an active key for it, of which only the hash is kept; a user's second channel is refused, in one batch too. Both tables follow
    from the same answers, so neither can have what the other lacks."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(order)) == 1
    known = channels.select("user_id", F.lit(True).alias("_has")).distinct()
    judged = requests.withColumn("_first", first).join(known, "user_id", "left")
    answers = judged.withColumn("verdict", F.when(F.col("_has") | ~F.col("_first"), "has a channel").otherwise("created")).drop("_has", "_first")
    made = key_hashes(answers.where("verdict = 'created'")).withColumns({"status": F.lit("ACTIVE"), "role": F.lit("USER")})
    return channels.unionByName(made.select(*CHANNEL)), keys.unionByName(made.select(*KEY)), answers.drop("plain")


def renew(channels: DataFrame, keys: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, keys, answers) after requests (channel_id, new_name, key_id, plain), one a channel: a name that is not blank is set; where plain is
    given, the channel's first key gets its hash, or a channel without keys an active one. Unknown channels are refused."""
    told = requests.join(channels.select("channel_id", F.col("user_id").alias("_user")), "channel_id", "left")
    answers = told.withColumn("verdict", F.when(F.col("_user").isNull(), "no such channel").otherwise("changed"))
    good = answers.where("verdict = 'changed'")
    named = good.where("new_name <> ''").select("channel_id", F.col("new_name").alias("channel_name"))
    first = keys.groupBy("channel_id").agg(F.min("key_id").alias("key_id"))
    hashed = good.where("plain is not null").select("channel_id", F.col("key_id").alias("_spare"), F.sha2("plain", 256).alias("key_hash"), F.col("_user").alias("user_id")).join(first, "channel_id", "left")
    changed = update(keys, hashed.where("key_id is not null").select("key_id", "key_hash", *(F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in keys.columns if c not in ("key_id", "key_hash"))), "key_id")
    spare = hashed.where("key_id is null").select(F.col("_spare").alias("key_id"), "channel_id", "key_hash", "user_id", F.lit("ACTIVE").alias("status"), F.lit("USER").alias("role"))
    return update(channels, named.select("channel_id", *(F.col(c) if c == "channel_name" else F.lit(None).cast(channels.schema[c].dataType).alias(c) for c in channels.columns if c != "channel_id")), "channel_id"), changed.unionByName(spare.select(*keys.columns)), answers.drop("plain", "_user")


def first_admin_keys(keys: DataFrame, users: DataFrame, requests: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(keys, answers) after requests (order, user_id, key_id, plain) for a first key: an admin of users (user_id, role) without an active key gets
    one, once; others are refused."""
    active = keys.where("status = 'ACTIVE'").select("user_id", F.lit(True).alias("_has")).distinct()
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(order)) == 1
    judged = requests.withColumn("_first", first).join(users.select("user_id", F.col("role").alias("_role")), "user_id", "left").join(active, "user_id", "left")
    verdict = F.when(F.coalesce(F.col("_role") != "ADMIN", F.lit(True)), "no admin").when(F.col("_has") | ~F.col("_first"), "has a key").otherwise("created")
    answers = judged.withColumn("verdict", verdict).drop("_role", "_has", "_first")
    made = key_hashes(answers.where("verdict = 'created'")).withColumns({"status": F.lit("ACTIVE"), "role": F.lit("ADMIN"), "channel_id": F.lit(None).cast(keys.schema["channel_id"].dataType)})
    return keys.unionByName(made.select(*keys.columns)), answers.drop("plain")
