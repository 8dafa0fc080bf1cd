"""Projections of the driver's tables that the queries share: messages, contexts, records, vectors, positions.

Each has its SQL twin, a WITH clause."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spatial
from ..operators import records

NOW = 1706745600000

# A small registry for the fields that `rec` has (fid, name, expected, range, status, unit), its next
# version, and importance by fid.
REGISTRY = [(1, "entity_id", "Int", "Core", "ACTIVE", None), (3, "sequence", "Int", "Core", "PROPOSED", None), (12, "user_id", "Int", "Core", "ACTIVE", None), (24, "tags", "StringArray", "Core", "ACTIVE", None), (40, "amount", "Int", "Core", "ACTIVE", "usd"), (50, "status", "String", "Core", "DEPRECATED", None), (300, "legacy_code", "String", "Core", "TOMBSTONED", None), (1100, "Bad-Name", "String", "Core", "ACTIVE", None)]
REGISTRY_NEXT = [(1, "entity_id", "String", "Core", "ACTIVE", None), (3, "seq_no", "Int", "Core", "ACTIVE", None), (12, "user_id", "Int", "Core", "ACTIVE", None), (40, "amount", "Float", "Core", "ACTIVE", "eur"), (50, "status", "String", "Core", "TOMBSTONED", None), (300, "legacy_code", "String", "Core", "ACTIVE", None), (2000, "added", "Int", "Standard", "ACTIVE", None)]
IMPORTANCE = [(22, 140), (41, 180), (51, 230)]
NAMES = {1: "entity_id", 12: "user_id", 40: "amount", 50: "status"}
EQUIVALENCES = [(50, "F", "finished"), (50, "o", "open"), (24, "5-LOW", "low")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, as of a file of one row group, dealt out for the work that follows; any
    other stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def _millis(c: str):  # noqa: ANN202
    return F.unix_millis(F.col(c).cast("timestamp"))


def registry(spark: SparkSession, rows: list[tuple] = REGISTRY) -> DataFrame:
    return spark.createDataFrame(rows, "fid int, name string, expected string, range string, status string, unit string")


def _values(rows: list[tuple], name: str, cols: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


REG_SQL = _values(REGISTRY, "reg", "fid, name, expected, range, status, unit")
REG_NEXT_SQL = _values(REGISTRY_NEXT, "reg2", "fid, name, expected, range, status, unit")
IMPORTANCE_SQL = _values(IMPORTANCE, "imp", "fid, importance")


# ---------------------------------------------------------------- messages


def msg(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "Alert").when(F.col("event_type") == "purchase", "Command").when(F.col("event_type") == "view", "Query").when(F.col("event_type") == "signup", "State").otherwise("Event")
    return e.select(
        "event_id",
        _millis("ts").alias("timestamp_ms"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 20).cast("string")).alias("source"),
        kind.alias("kind"),
        (F.col("event_id") * 37 % 256).cast("int").alias("priority"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (_millis("ts") + F.col("event_id") % 12 * 1000).alias("now_ms"),
        "value",
    )


MSG = """msg AS (SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms, 'svc-' || (user_id % 20) AS source,
  CASE event_type WHEN 'error' THEN 'Alert' WHEN 'purchase' THEN 'Command' WHEN 'view' THEN 'Query' WHEN 'signup' THEN 'State' ELSE 'Event' END AS kind,
  (event_id * 37 % 256)::INTEGER AS priority, (props->>'$.k')::INTEGER AS k, epoch_us(ts) // 1000 + event_id % 12 * 1000 AS now_ms, value FROM events)"""
TTL = "CASE kind WHEN 'Alert' THEN 1000 WHEN 'Command' THEN 2000 WHEN 'Query' THEN 5000 WHEN 'State' THEN 10000 ELSE 5000 END"
PRIORITY = "CASE kind WHEN 'Alert' THEN 255 WHEN 'Command' THEN 150 WHEN 'Query' THEN 120 ELSE 100 END"


# ---------------------------------------------------------------- contexts


def ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as envelopes; importance from the fields that labels give them: the largest of their fids' values."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "toxic")
    joined = d.select("doc_id", "source", "lang").join(labels, F.col("doc_id") == F.col("l"), "left")
    own = F.greatest(F.lit(140), F.when(F.col("l").isNotNull(), 180), F.when(F.col("toxic") == 1, 230))
    return joined.select("doc_id", "source", "lang", (F.lit(NOW) - F.col("doc_id") % 240 * 900000).alias("timestamp_ms"), own.alias("own_importance"))


CTX = f"""ctx AS (SELECT d.doc_id, d.source, d.lang, {NOW} - d.doc_id % 240 * 900000 AS timestamp_ms,
  CASE WHEN toxic = 1 THEN 230 WHEN l.doc_id IS NOT NULL THEN 180 ELSE 140 END AS importance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
prof AS (SELECT *, exp(-(greatest({NOW} - timestamp_ms, 0)::DOUBLE / 3600000e0) / 24e0) AS freshness,
  CASE WHEN contains(source, 'src1') THEN 0.7e0 ELSE 0.5e0 END AS confidence, CASE WHEN contains(source, 'src9') THEN 2 ELSE 0 END AS risk FROM ctx),
scored AS (SELECT *, least(1e0, greatest(0e0, (0.3e0 * freshness + 0.4e0 * (importance::DOUBLE / 255e0) + 0.3e0 * confidence) * CASE risk WHEN 0 THEN 1e0 ELSE 0.5e0 END)) AS score FROM prof)"""


# ---------------------------------------------------------------- records


def rec(spark: SparkSession, sf_dir: str, new: bool = False) -> DataFrame:
    """(rec_id, rec) of orders; new: without field 24 where the key divides by 7, another 40 where by 5, a field 3
    where by 11."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    o = spread(o)
    key = F.col("o_orderkey")
    always = F.lit(True)
    total = F.when(key % 5 == 0, F.col("o_totalprice") + 1.0).otherwise(F.col("o_totalprice")) if new else F.col("o_totalprice")
    fields = [
        (50, "s", F.col("o_orderstatus"), always),
        (1, "i", key, always),
        (12, "i", F.col("o_custkey"), always),
        (40, "f", total, always),
        (105, "i", _millis("o_orderdate"), always),
        (24, "sa", F.array("o_orderpriority"), key % 7 != 0 if new else always),
        *([(3, "i", F.lit(1), key % 11 == 0)] if new else []),
    ]
    return o.select(key.alias("rec_id"), records.record(*fields).alias("rec"))


NUM = "regexp_replace(o_totalprice::VARCHAR, '\\.0$', '')"
DATE = "epoch_us(o_orderdate) // 1000"
QUOTED = "CASE WHEN regexp_matches(o_orderpriority, '^[A-Za-z0-9_.-]+$') THEN o_orderpriority ELSE '\"' || o_orderpriority || '\"' END"


def fields(spark: SparkSession, sf_dir: str, new: bool = False) -> DataFrame:
    return records.to_fields(rec(spark, sf_dir, new), "rec", "rec_id")


#: The field table with each value as text.
FIELDS = f"""fields AS (SELECT o_orderkey AS rec_id, unnest([50, 1, 12, 40, 105, 24]) AS fid, unnest(['s', 'i', 'i', 'f', 'i', 'sa']) AS tag,
  unnest([o_orderstatus, o_orderkey::VARCHAR, o_custkey::VARCHAR, {NUM}, ({DATE})::VARCHAR, o_orderpriority]) AS v FROM orders)"""
NUM_NEW = "regexp_replace((CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1e0 ELSE o_totalprice END)::VARCHAR, '\\.0$', '')"
FIELDS_NEW = f"""fields2 AS (SELECT * FROM (SELECT o_orderkey AS rec_id, unnest([50, 1, 12, 40, 105, 24, 3]) AS fid,
  unnest([o_orderstatus, o_orderkey::VARCHAR, o_custkey::VARCHAR, {NUM_NEW}, ({DATE})::VARCHAR, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 11 = 0 THEN '1' END]) AS v FROM orders) WHERE v IS NOT NULL)"""

#: CRC-32 of an ASCII text expression.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


# ---------------------------------------------------------------- vectors and positions


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


#: Line items in one order: line numbers repeat.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax")
LINE_SQL = ", ".join(LINE[1:])


def pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    p = spatial.position(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    return t.select(*LINE, p.alias("p"))


POS = f"pos AS (SELECT l_orderkey, {LINE_SQL}, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)"
