"""Queries of channels and keys, and of sequences of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import channels, graph
from .catalogue import BY, LONG, query
from .views import CANDIDATES, candidates, table

# Customers as channels of users: every third user has one, and two keys; orders ask for more.

TABLES = """channels as (select c_custkey as channel_id, c_name as channel_name, c_custkey as user_id, 'ACTIVE' as status from customer where c_custkey % 3 = 0),
keys as (select c_custkey * 10 + k as key_id, c_custkey as channel_id, sha256('old ' || c_custkey || k) as key_hash, c_custkey as user_id, case when c_custkey % 4 = 0 then 'REVOKED' else 'ACTIVE' end as status, 'USER' as role
  from customer, (select unnest([0, 1]) as k) where c_custkey % 6 = 0),
asks as (select o_orderkey as n, o_custkey as user_id, o_orderkey + 1000000000 as channel_id, 'channel ' || o_orderkey as channel_name, o_orderkey + 2000000000 as key_id, 'plain ' || o_orderkey as plain from orders)"""
CREATED = f"""with {TABLES}, judged as (select *, case when exists (select 1 from channels c where c.user_id = a.user_id) or n > min(n) over (partition by user_id) then 'has a channel' else 'created' end as verdict from asks a)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("c_custkey").cast(LONG)
    customer = table(spark, sf_dir, "customer")
    own = customer.where("c_custkey % 3 = 0").select(n.alias("channel_id"), F.col("c_name").alias("channel_name"), n.alias("user_id"), F.lit("ACTIVE").alias("status"))
    pairs = customer.where("c_custkey % 6 = 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = pairs.select((n * 10 + F.col("k")).alias("key_id"), n.alias("channel_id"), F.sha2(F.concat(F.lit("old "), n, "k"), 256).alias("key_hash"), n.alias("user_id"), F.when(n % 4 == 0, "REVOKED").otherwise("ACTIVE").alias("status"), F.lit("USER").alias("role"))
    o = F.col("o_orderkey").cast(LONG)
    asks = table(spark, sf_dir, "orders").select(o.alias("n"), F.col("o_custkey").cast(LONG).alias("user_id"), (o + 1_000_000_000).alias("channel_id"), F.concat(F.lit("channel "), o).alias("channel_name"), (o + 2_000_000_000).alias("key_id"), F.concat(F.lit("plain "), o).alias("plain"))
    return own, keys, asks


@query(f"{CREATED} select n, user_id, channel_id, channel_name, key_id, verdict from judged")
def channel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.create(*_tables(spark, sf_dir), "n")[2]


@query(f"""{CREATED} select channel_id, channel_name, user_id, status, key_id, key_hash from (select * from channels union all select channel_id, channel_name, user_id, 'ACTIVE' from judged where verdict = 'created')
left join (select channel_id, key_id, key_hash from keys union all select channel_id, key_id, sha256(plain) from judged where verdict = 'created') using (channel_id)""")
def channel_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, keys, _ = channels.create(*_tables(spark, sf_dir), "n")
    return own.join(keys.select("channel_id", "key_id", "key_hash"), "channel_id", "left")


@query(f"""with {TABLES}, asked as (select c_custkey as channel_id, case when c_custkey % 5 = 0 then '' when c_custkey % 5 < 3 then 'new ' || c_custkey end as new_name, c_custkey + 3000000000 as spare, case when c_custkey % 2 = 0 then 'fresh ' || c_custkey end as plain from customer),
good as (select a.*, c.user_id from asked a join channels c using (channel_id)), firsts as (select channel_id, min(key_id) as key_id from keys group by 1),
after as (select k.key_id, k.channel_id, case when g.plain is not null and k.key_id = f.key_id then sha256(g.plain) else k.key_hash end as key_hash, k.status from keys k left join good g using (channel_id) left join firsts f on f.channel_id = k.channel_id
  union all select spare, channel_id, sha256(plain), 'ACTIVE' from good where plain is not null and channel_id not in (select channel_id from firsts))
select c.channel_id, case when g.new_name <> '' then g.new_name else c.channel_name end as channel_name, a.key_id, a.key_hash, a.status from channels c left join good g using (channel_id) left join after a on a.channel_id = c.channel_id""")
def channel_renew(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, keys, _ = _tables(spark, sf_dir)
    n = F.col("c_custkey").cast(LONG)
    name = F.when(n % 5 == 0, "").when(n % 5 < 3, F.concat(F.lit("new "), n))
    asked = table(spark, sf_dir, "customer").select(n.alias("channel_id"), name.alias("new_name"), (n + 3_000_000_000).alias("key_id"), F.when(n % 2 == 0, F.concat(F.lit("fresh "), n)).alias("plain"))
    own, keys, _ = channels.renew(own, keys, asked)
    return own.select("channel_id", "channel_name").join(keys.select("channel_id", "key_id", "key_hash", "status"), "channel_id", "left")


@query(f"""with {TABLES}, users as (select c_custkey as user_id, case when c_custkey % 2 = 0 then 'ADMIN' else 'USER' end as role from customer where c_custkey % 7 <> 0)
select n, user_id, key_id, case when user_id not in (select user_id from users where role = 'ADMIN') then 'no admin' when user_id in (select user_id from keys where status = 'ACTIVE') or n > min(n) over (partition by user_id) then 'has a key' else 'created' end as verdict from asks""")
def admin_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, keys, asks = _tables(spark, sf_dir)
    n = F.col("c_custkey").cast(LONG)
    users = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(n.alias("user_id"), F.when(n % 2 == 0, "ADMIN").otherwise("USER").alias("role"))
    return channels.first_admin_keys(keys, users, asks.select("n", "user_id", "key_id", "plain"), "n")[1]


@query("""select c_custkey, case when c_custkey % 3 = 0 then null else c_name end as c_name, case when c_custkey % 3 = 1 then 'patched' else segment end as segment, case when c_custkey % 3 = 1 then null else nation end as nation
from (select c_custkey, c_name, c_mktsegment as segment, 'n' || c_nationkey as nation from customer)""")
def dim_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"))
    given = F.when(n % 3 == 0, F.array(F.lit("c_name"))).otherwise(F.array(F.lit("segment"), F.lit("nation")))
    none = F.lit(None).cast("string")
    changes = c.where("c_custkey % 3 < 2").select("c_custkey", given.alias("given"), none.alias("c_name"), F.lit("patched").alias("segment"), none.alias("nation"))
    return channels.patch(c, changes, "c_custkey")


# Candidates that continue others of their chunk, of the chunk before, or by edges.

LINKED = f"""with recursive {CANDIDATES}, c as (select source_id, cand_idx, start_ms, kind, chunk, row_number() over (partition by source_id, chunk order by start_ms, cand_idx) - 1 as place from (select *, start_ms // 864000000 as chunk from candidates)),
told as (select *, case when cand_idx % 3 = 0 then chunk when cand_idx % 5 = 0 then chunk - 1 end as fc, case when cand_idx % 3 = 0 then place - 1 when cand_idx % 5 = 0 then cast(cand_idx % 4 as bigint) * 3 end as fp from c)"""
WALK = """twoway as (select a, b from links where a <> b union select b, a from links where a <> b),
reach(a, b) as (select cand_idx, cand_idx from c union select r.a, x.b from reach r join twoway x on r.b = x.a),
roots as (select a as cand_idx, min(b) as root from reach group by 1),
put as (select c.source_id, c.cand_idx, root, min(start_ms) over (partition by source_id, root) as first from c join roots using (cand_idx))
select source_id, cand_idx, cast(dense_rank() over (partition by source_id order by first, root) - 1 as bigint) as sequence_id from put"""


def _continuing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).withColumn("chunk_index", F.floor(F.col("start_ms") / 864_000_000).cast(LONG))
    c = c.withColumn("candidate_index", (F.row_number().over(Window.partitionBy("source_id", "chunk_index").orderBy("start_ms", "cand_idx")) - 1).cast(LONG))
    n = F.col("cand_idx")
    said = {"from_chunk": F.when(n % 3 == 0, F.col("chunk_index")).when(n % 5 == 0, F.col("chunk_index") - 1), "from_candidate": F.when(n % 3 == 0, F.col("candidate_index") - 1).when(n % 5 == 0, (n % 4 * 3).cast(LONG))}
    return c.withColumns(said).select("source_id", "cand_idx", "start_ms", "kind", "chunk_index", "candidate_index", "from_chunk", "from_candidate")


@query(f"""{LINKED}, near as (select t.source_id, t.cand_idx as a, x.cand_idx as b, t.fc, t.fp from told t left join c x on x.source_id = t.source_id and x.chunk = t.chunk and x.place = t.fp where t.fp is not null),
links as (select a, b from near where b is not null union all select n.a, x.cand_idx from near n join c x on x.source_id = n.source_id and x.chunk = n.fc and x.place = n.fp where n.b is null), {WALK}""")
def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sequences(_continuing(spark, sf_dir), BY, "cand_idx", "start_ms").select("source_id", "cand_idx", F.col("sequence_id").cast(LONG).alias("sequence_id"))


@query(f"""{LINKED}, links as (select t.cand_idx as a, x.cand_idx as b from told t join c x on x.source_id = t.source_id and x.chunk = t.chunk and x.place = t.fp where t.fc = t.chunk
  union all select t.cand_idx, x.cand_idx from c t join c x on x.source_id = t.source_id and x.chunk = t.chunk + 1 and x.place = 0 where t.kind = 'click' and t.cand_idx % 2 = 0), {WALK}""")
def event_sequences_by_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _continuing(spark, sf_dir)
    kind = F.when((F.col("kind") == "click") & (F.col("cand_idx") % 2 == 0), "continuous").otherwise("contrast")
    edges = c.select("source_id", kind.alias("type"), F.col("chunk_index").alias("from_chunk"), F.col("candidate_index").alias("from_candidate"), (F.col("chunk_index") + 1).alias("to_chunk"), F.lit(None).cast(LONG).alias("to_candidate"))
    return graph.sequences(c, BY, "cand_idx", "start_ms", edges).select("source_id", "cand_idx", F.col("sequence_id").cast(LONG).alias("sequence_id"))
