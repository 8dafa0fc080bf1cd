"""Queries by name: QUERIES has the functions, SQL the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checksum, context, fmt, ordered, routing, spatial, transport, vectors
from ..operators import bridge, delta, negotiation, records, registry
from ..sources import binary, container, text
from ..streaming import chunks, messages, receiver
from . import tables as t
from .tables import CRC_TABLE, CTX, DATE, FIELDS, FIELDS_NEW, IMPORTANCE_SQL, LINE_SQL, MSG, NOW, NUM, POS, PRIORITY, QUOTED, REG_NEXT_SQL, REG_SQL, TTL, crc_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: str | object, digits: int = 6):  # noqa: ANN202
    return F.round(c, digits)


# ================================================================ context

SCORER = context.Scorer(trusted=("src1",), suspicious=("src9",))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.with_profile(t.ctx(spark, sf_dir), NOW, SCORER, importance="own_importance")


@query(f"WITH {CTX} SELECT doc_id, round(freshness, 6) AS freshness, importance, risk, confidence, round(score, 6) AS score FROM scored")
def ctx_profile(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", _r("freshness").alias("freshness"), "importance", "risk", "confidence", _r("score").alias("score"))


@query(f"WITH {CTX} SELECT doc_id, round(score, 6) AS score FROM scored WHERE score >= 0.6e0 ORDER BY score DESC, doc_id LIMIT 20")
def ctx_topk(spark, sf_dir):
    return context.top_k(context.by_threshold(_scored(spark, sf_dir), 0.6), 20, "doc_id").select("doc_id", _r("score").alias("score"))


@query(f"WITH {CTX} SELECT doc_id, score >= 0.6e0 AS good, freshness >= 0.9e0 AS fresh FROM scored WHERE score >= 0.6e0 OR freshness >= 0.9e0")
def ctx_threshold(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.where((F.col("score") >= 0.6) | (F.col("freshness") >= 0.9)).select("doc_id", (F.col("score") >= 0.6).alias("good"), (F.col("freshness") >= 0.9).alias("fresh"))


@query(f"WITH {CTX} SELECT doc_id FROM scored WHERE freshness >= 0.9e0")
def ctx_fresh(spark, sf_dir):
    return context.by_freshness(_scored(spark, sf_dir), 0.9).select("doc_id")


@query(f"WITH {CTX} SELECT doc_id, risk, importance FROM scored WHERE risk <= 1 AND importance >= 180")
def ctx_risk_filter(spark, sf_dir):
    return context.by_importance(context.by_risk(_scored(spark, sf_dir), 1), 180).select("doc_id", "risk", "importance")


@query(f"WITH {CTX} SELECT doc_id, lang, round(score, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM scored")
def ctx_rank(spark, sf_dir):
    return context.rank_within(_scored(spark, sf_dir), "lang", "doc_id").select("doc_id", "lang", _r("score").alias("score"), "rank")


@query(f"""WITH {CTX} SELECT count(*) AS n, round(avg(freshness), 6) AS avg_freshness, (sum(importance) // count(*))::BIGINT AS avg_importance, round(avg(confidence), 6) AS avg_confidence,
  count(*) FILTER (risk = 0) AS low_risk, count(*) FILTER (risk = 1) AS medium_risk, count(*) FILTER (risk = 2) AS high_risk, count(*) FILTER (risk = 3) AS critical_risk FROM scored""")
def ctx_stats(spark, sf_dir):
    return context.stats(_scored(spark, sf_dir)).withColumns({c: _r(c) for c in ("avg_freshness", "avg_confidence")})


@query(f"""WITH {CTX} SELECT doc_id, round(least(1e0, greatest(0e0, (0.5e0 * freshness + 0.25e0 * (importance::DOUBLE / 255e0) + 0.25e0 * confidence) * CASE risk WHEN 0 THEN 1e0 ELSE 0.5e0 END)), 6) AS score FROM scored""")
def ctx_custom_weights(spark, sf_dir):
    return context.reweighted(_scored(spark, sf_dir), context.Weights(2.0, 1.0, 1.0).normalized()).select("doc_id", _r("score").alias("score"))


@query(f"""WITH {IMPORTANCE_SQL}, f AS (SELECT d.doc_id, 22 AS fid FROM documents d UNION ALL SELECT doc_id, 41 FROM labels UNION ALL SELECT doc_id, 51 FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 99 FROM documents)
  SELECT doc_id, coalesce(max(importance), 128)::INTEGER AS importance FROM f LEFT JOIN imp USING (fid) GROUP BY doc_id""")
def dict_importance(spark, sf_dir):
    d, labels = t.table(spark, sf_dir, "documents").select("doc_id"), t.table(spark, sf_dir, "labels")
    f = d.withColumn("fid", F.explode(F.array(F.lit(22), F.lit(99)))).unionByName(labels.select("doc_id", F.lit(41).alias("fid"))).unionByName(labels.where("toxic = 1").select("doc_id", F.lit(51).alias("fid")))
    return registry.importance_by_record(f, spark.createDataFrame(t.IMPORTANCE, "fid int, importance int"), "doc_id")


# ================================================================ messages and routing


@query(f"WITH {MSG} SELECT kind, {PRIORITY} AS priority, {TTL} AS ttl_ms, count(*) AS n FROM msg GROUP BY ALL")
def net_defaults(spark, sf_dir):
    k = F.col("kind")
    return t.msg(spark, sf_dir).groupBy("kind", routing.default_priority(k).alias("priority"), routing.default_ttl_ms(k).alias("ttl_ms")).agg(F.count("*").alias("n"))


@query(f"WITH {MSG} SELECT event_id, greatest(now_ms - timestamp_ms, 0) AS age_ms, greatest(now_ms - timestamp_ms, 0) > {TTL} AS expired, timestamp_ms + {TTL} <= now_ms AS expired_at FROM msg")
def net_expired(spark, sf_dir):
    ts, now, ttl = F.col("timestamp_ms"), F.col("now_ms"), routing.default_ttl_ms(F.col("kind"))
    return t.msg(spark, sf_dir).select("event_id", routing.age_ms(ts, now).alias("age_ms"), routing.is_expired(ts, ttl, now).alias("expired"), routing.is_expired_at(ts + ttl, now).alias("expired_at"))


ROUTED = f"""{MSG}, r AS (SELECT *, greatest(now_ms - timestamp_ms, 0) AS age_ms, greatest(now_ms - timestamp_ms, 0) > {TTL} AS expired,
  0.5e0 * (priority::DOUBLE / 255e0) + 0.5e0 * least(1e0, greatest(0e0, 0.3e0 * exp(-(greatest(now_ms - timestamp_ms, 0)::DOUBLE / 3600000e0) / 24e0) + 0.4e0 * (128e0 / 255e0) + 0.3e0 * 0.5e0)) AS importance FROM msg),
routed AS (SELECT *, CASE WHEN expired THEN 'Drop' WHEN kind = 'Alert' AND priority > 200 THEN 'SendToLLM' WHEN kind IN ('Event', 'State') AND importance >= 0.7e0 THEN 'SendToLLM' ELSE 'ProcessLocally' END AS decision FROM r)"""


def _routed(spark, sf_dir):
    ts, now, kind, pri = F.col("timestamp_ms"), F.col("now_ms"), F.col("kind"), F.col("priority")
    m = t.msg(spark, sf_dir).withColumns({"age_ms": routing.age_ms(ts, now), "expired": routing.is_expired(ts, routing.default_ttl_ms(kind), now), "importance": routing.base_importance(pri, ts, F.col("source"), now)})
    return m.withColumn("decision", routing.route(kind, pri, F.col("expired"), F.col("importance")))


@query(f"WITH {ROUTED} SELECT event_id, round(importance, 6) AS importance, decision FROM routed")
def net_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("event_id", _r("importance").alias("importance"), "decision")


@query(f"WITH {ROUTED} SELECT event_id, CASE WHEN timestamp_ms + {TTL} <= now_ms THEN 'Drop' WHEN kind = 'Alert' AND priority > 200 THEN 'SendToLLM' WHEN kind IN ('Event', 'State') AND importance >= 0.7e0 THEN 'SendToLLM' ELSE 'ProcessLocally' END AS decision FROM routed")
def net_route_view(spark, sf_dir):
    m = _routed(spark, sf_dir)
    at = routing.is_expired_at(F.col("timestamp_ms") + routing.default_ttl_ms(F.col("kind")), F.col("now_ms"))
    return m.select("event_id", routing.route(F.col("kind"), F.col("priority"), at, F.col("importance")).alias("decision"))


@query(f"""WITH {ROUTED} SELECT event_id, CASE WHEN expired THEN 'Drop' WHEN k = 3 THEN 'SendToLLM' WHEN k BETWEEN 5 AND 9 THEN 'Drop' WHEN contains(source, 'svc-1') AND source IN ('svc-1', 'svc-11') THEN 'ProcessLocally'
  WHEN kind = 'Alert' AND priority > 200 THEN 'SendToLLM' WHEN priority::DOUBLE / 255e0 >= 0.7e0 THEN 'SendToLLM' ELSE 'ProcessLocally' END AS decision FROM routed""")
def net_content_rules(spark, sf_dir):
    m = _routed(spark, sf_dir)
    rules = [routing.Rule("k", "equals", 3), routing.Rule("k", "between", (5, 9), routing.DROP), routing.Rule("source", "in", ("svc-1", "svc-11"), routing.LOCAL), routing.Rule("k", "missing", None, routing.DROP)]
    return m.select("event_id", routing.route_by_content(m, rules, F.col("kind"), F.col("priority"), F.col("expired")).alias("decision"))


@query(f"WITH {MSG} SELECT event_id, (k > 50)::BOOLEAN AS above, k < 10 AS below, contains(source, 'c-1') AS has, k IS NOT NULL AS there FROM msg")
def net_conditions(spark, sf_dir):
    m = t.msg(spark, sf_dir)
    rule = lambda f, op, v=None: routing.Rule(f, op, v).holds(m[f])
    return m.select("event_id", rule("k", "above", 50).alias("above"), rule("k", "below", 10).alias("below"), rule("source", "contains", "c-1").alias("has"), rule("k", "exists").alias("there"))


@query(f"""WITH {ROUTED} SELECT (timestamp_ms // 86400000) * 86400000 AS day_ms, kind, count(*) AS n, round(count(*) FILTER (decision = 'Drop') / count(*), 6) AS drop_rate, round(count(*) FILTER (decision = 'SendToLLM') / count(*), 6) AS llm_rate, quantile_disc(age_ms, 0.99)::BIGINT AS age_p99 FROM routed GROUP BY ALL""")
def net_metrics_window(spark, sf_dir):
    day = F.unix_millis(F.window(F.timestamp_millis("timestamp_ms"), "1 day")["start"]).alias("day_ms")
    return routing.metrics(_routed(spark, sf_dir), day, F.col("kind")).select("day_ms", "kind", "n", _r("drop_rate").alias("drop_rate"), _r("llm_rate").alias("llm_rate"), "age_p99")


@query(f"WITH {MSG} SELECT CASE WHEN priority <= 50 THEN 'low' WHEN priority <= 200 THEN 'normal' ELSE 'high' END AS band, count(*) AS n FROM msg GROUP BY ALL")
def net_bands(spark, sf_dir):
    return t.msg(spark, sf_dir).groupBy(routing.band(F.col("priority")).alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {MSG}, s AS (SELECT source, timestamp_ms, event_id, k, lag(k) OVER (PARTITION BY source ORDER BY timestamp_ms, event_id) AS before FROM msg WHERE kind = 'State') SELECT event_id, source, k FROM s WHERE before IS DISTINCT FROM k")
def net_state_changes(spark, sf_dir):
    states = ordered.previous(t.msg(spark, sf_dir).where("kind = 'State'"), ["source"], F.floor(F.col("timestamp_ms") / 86400000), "k", "timestamp_ms", "event_id", out="b")
    return states.where("b is distinct from k").select("event_id", "source", "k")


@query(f"""WITH {MSG}, s AS (SELECT source, timestamp_ms, CASE WHEN timestamp_ms - lag(timestamp_ms) OVER w < 1800000 THEN 0 ELSE 1 END AS new, event_id FROM msg WINDOW w AS (PARTITION BY source ORDER BY timestamp_ms, event_id)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY timestamp_ms, event_id) AS g FROM s) SELECT source, min(timestamp_ms) AS start_ms, count(*) AS n FROM g GROUP BY source, g""")
def net_sessions(spark, sf_dir):
    m = t.msg(spark, sf_dir).withColumn("event_time", F.timestamp_millis("timestamp_ms"))
    return messages.sessions(m).select("source", F.unix_millis("session_window.start").alias("start_ms"), "n")


# ================================================================ vectors

PAIRS = "pairs AS (SELECT q.vec_id AS q, v.vec_id AS v, q.embedding::DOUBLE[] AS a, v.embedding::DOUBLE[] AS b FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"


def _pairs(spark, sf_dir):
    """A stated query set, every hundredth vector, against all. It grows with the table, so it is broadcast only by
    Spark's own check of its size."""
    v = t.vec(spark, sf_dir)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"))
    return v.select(F.col("vec_id").alias("v"), F.col("embedding").alias("b")).join(q)


@query(f"WITH {PAIRS} SELECT q, v, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_inner_product(a, b), 6) AS dot, round(list_distance(a, b), 6) AS l2 FROM pairs")
def vec_similarity(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("q", "v", _r(vectors.cosine(a, b)).alias("cosine"), _r(vectors.dot(a, b)).alias("dot"), _r(vectors.euclidean(a, b)).alias("l2"))


@query(f"WITH {PAIRS} SELECT q, v, rank FROM (SELECT q, v, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(a, b), 9) DESC, v) AS rank FROM pairs WHERE q <> v) WHERE rank <= 10")
def vec_knn(spark, sf_dir):
    """Ten nearest of each query: only the ten best of a partition leave it."""
    p = _pairs(spark, sf_dir).where("q <> v").select("q", "v", F.round(vectors.cosine(F.col("a"), F.col("b")), 9).alias("c"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("c"), "v"))
    return p.withColumn("rank", rank).where("rank <= 10").select("q", "v", "rank")


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
  SELECT vec_id, round(n * n, 4) AS squared, round(sqrt(list_sum(list_transform(e, lambda x: ((x / n)::FLOAT)::DOUBLE ** 2))), 4) AS unit, round((e[1] / n)::FLOAT::DOUBLE, 5) AS first, round((e[64] / n)::FLOAT::DOUBLE, 5) AS last FROM n""")
def vec_normalize(spark, sf_dir):
    n = vectors.normalize(F.col("embedding"))
    return t.vec(spark, sf_dir).select("vec_id", _r(vectors.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"), _r(vectors.norm(n), 4).alias("unit"), *[_r(F.get(n, F.lit(k)).cast("double"), 5).alias(c) for k, c in ((0, "first"), (63, "last"))])


def _deltas(spark, sf_dir):
    changed = F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 7 == 0, (x + F.lit(0.5).cast("float")).cast("float")).otherwise(x))
    return t.vec(spark, sf_dir).withColumn("new", changed).withColumn("changes", vectors.delta(F.col("embedding"), F.col("new")))


@query("""WITH d AS (SELECT vec_id, list_filter(range(64), lambda i: (i + vec_id) % 7 = 0) AS idx FROM embeddings)
  SELECT vec_id, len(idx)::INTEGER AS n, list_sum(idx)::BIGINT AS places, (4 + 6 * len(idx))::INTEGER AS bytes, CASE WHEN len(idx) / 64e0 < 0.3e0 THEN 'delta' ELSE 'full' END AS kind, TRUE AS restored FROM d""")
def vec_delta(spark, sf_dir):
    c = F.col("changes")
    d = _deltas(spark, sf_dir)
    near = vectors.euclidean(vectors.apply_delta(F.col("embedding"), c), F.col("new")) < 1e-5
    return d.select("vec_id", F.size(c).alias("n"), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["index"]).alias("places"), vectors.delta_bytes(c).alias("bytes"), vectors.update_kind(c, F.size("embedding")).alias("kind"), near.alias("restored"))


SCALE8 = "SELECT vec_id, embedding AS e, list_min(embedding) AS low, ((list_max(embedding) - list_min(embedding))::FLOAT / 255::FLOAT)::FLOAT AS scale FROM embeddings"
INT8 = f"s AS ({SCALE8}), q AS (SELECT *, list_transform(e, lambda x: greatest(-128, least(127, trunc(((x - low)::FLOAT / scale)::FLOAT)::INTEGER - 128))) AS codes FROM s)"


@query(f"WITH {INT8} SELECT vec_id, codes::INTEGER[] AS codes, round(scale::DOUBLE, 9) AS scale FROM q")
def quant_int8(spark, sf_dir):
    return t.vec(spark, sf_dir).withColumn("q", vectors.quantize_int8(F.col("embedding"))).select("vec_id", F.col("q.data").alias("codes"), F.round(F.col("q.scale").cast("double"), 9).alias("scale"))


@query(f"""WITH {INT8} SELECT vec_id, round(list_sum(list_transform(list_zip(e, codes), lambda p: abs(p[1]::DOUBLE - ((((p[2] + 128)::FLOAT * scale)::FLOAT + low)::FLOAT)::DOUBLE))) / list_sum(list_transform(e, lambda x: abs(x::DOUBLE))), 5) AS loss FROM q""")
def quant_int8_error(spark, sf_dir):
    e = F.col("embedding")
    q = t.vec(spark, sf_dir).withColumn("q", vectors.quantize_int8(e))
    return q.select("vec_id", _r(vectors.loss(e, vectors.dequantize_int8(F.col("q"))), 5).alias("loss"))


INT4 = """s AS (SELECT vec_id, embedding AS e, list_min(embedding) AS low, ((list_max(embedding) - list_min(embedding))::FLOAT / 15::FLOAT)::FLOAT AS scale FROM embeddings),
  q AS (SELECT vec_id, list_transform(e, lambda x: greatest(0, least(15, round((((x - low)::FLOAT / scale)::FLOAT)::DOUBLE)::INTEGER))) AS c FROM s)"""


@query(f"WITH {INT4} SELECT vec_id, list_transform(range(32), lambda i: c[2 * i + 1] * 16 + c[2 * i + 2])::INTEGER[] AS data FROM q")
def quant_int4(spark, sf_dir):
    return t.vec(spark, sf_dir).select("vec_id", vectors.quantize_int4(F.col("embedding"))["data"].alias("data"))


BACK = f"""{INT8}, b8 AS (SELECT vec_id, list_max(list_transform(list_zip(e, codes), lambda p: abs(p[1]::DOUBLE - ((((p[2] + 128)::FLOAT * scale)::FLOAT + low)::FLOAT)::DOUBLE))) / scale AS steps8 FROM q),
  {INT4.replace('s AS', 's4 AS').replace('q AS (SELECT vec_id', 'q4 AS (SELECT *').replace('FROM s)', 'FROM s4)')}, b4 AS (SELECT vec_id, list_max(list_transform(list_zip(e, c), lambda p: abs(p[1]::DOUBLE - (((p[2]::FLOAT * scale)::FLOAT + low)::FLOAT)::DOUBLE))) / scale AS steps4 FROM q4),
  m AS (SELECT vec_id, len(list_filter(embedding, lambda x: x >= mean)) AS above FROM (SELECT vec_id, embedding, (list_reduce([0::FLOAT] || embedding, lambda s, x: (s + x)::FLOAT) / 64)::FLOAT AS mean FROM embeddings))"""


@query(f"WITH {BACK} SELECT vec_id, round(steps8, 3) AS int8_steps, round(steps4, 3) AS int4_steps, steps8 <= 1.001e0 AS int8_ok, steps4 <= 0.501e0 AS int4_ok, (2 * above - 64)::DOUBLE AS binary_sum FROM b8 JOIN b4 USING (vec_id) JOIN m USING (vec_id)")
def quant_roundtrip(spark, sf_dir):
    """Largest error of each scheme, in steps of its scale: at most one for int8, half for int4; the sum of binary's signs."""
    e = F.col("embedding")
    v = t.vec(spark, sf_dir).withColumns({"q8": vectors.quantize_int8(e), "q4": vectors.quantize_int4(e), "q1": vectors.quantize_binary(e)})
    steps = lambda back, q: F.array_max(F.zip_with(e, back, lambda x, y: F.abs(x.cast("double") - y.cast("double")))) / F.col(f"{q}.scale").cast("double")
    v = v.select("vec_id", steps(vectors.dequantize_int8(F.col("q8")), "q8").alias("s8"), steps(vectors.dequantize_int4(F.col("q4")), "q4").alias("s4"), F.aggregate(vectors.dequantize_binary(F.col("q1")), F.lit(0.0), lambda s, x: s + x).alias("binary_sum"))
    return v.select("vec_id", _r("s8", 3).alias("int8_steps"), _r("s4", 3).alias("int4_steps"), (F.col("s8") <= 1.001).alias("int8_ok"), (F.col("s4") <= 0.501).alias("int4_ok"), "binary_sum")


@query("""WITH m AS (SELECT vec_id, embedding AS e, (list_reduce([0::FLOAT] || embedding, lambda s, x: (s + x)::FLOAT) / 64)::FLOAT AS mean FROM embeddings)
  SELECT vec_id, list_transform(range(8), lambda b: list_sum(list_transform(range(8), lambda k: CASE WHEN e[b * 8 + k + 1] >= mean THEN 1 << k ELSE 0 END)))::INTEGER[] AS data FROM m""")
def quant_binary(spark, sf_dir):
    return t.vec(spark, sf_dir).select("vec_id", vectors.quantize_binary(F.col("embedding"))["data"].alias("data"))


@query("""SELECT unnest(['fp16', 'qint8', 'qint4', 'binary']) AS scheme, unnest([128, 64, 32, 8])::BIGINT * (SELECT count(*) FROM embeddings) AS bytes, unnest([2e0, 4e0, 8e0, 32e0]) AS ratio""")
def quant_ratio(spark, sf_dir):
    n = F.size("embedding")
    rows = F.array(*[F.struct(F.lit(s).alias("scheme"), vectors.scheme_bytes(s, n).alias("b"), vectors.compression_ratio(s, n).alias("r")) for s in ("fp16", "qint8", "qint4", "binary")])
    return t.vec(spark, sf_dir).select(F.inline(rows)).groupBy("scheme").agg(F.sum("b").alias("bytes"), F.avg("r").alias("ratio"))


@query("SELECT count(*) AS total, count(*) FILTER (len(embedding) > 0) AS succeeded, count(*) FILTER (len(embedding) = 0) AS failed FROM embeddings")
def quant_batch_stats(spark, sf_dir):
    ok = vectors.quantize_int8(F.col("embedding")).isNotNull()
    return t.vec(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


# ================================================================ records


@query(f"WITH {CRC_TABLE}, {FIELDS} SELECT rec_id, fid, lpad(upper(to_hex({crc_sql('x')})), 8, '0') AS checksum FROM (SELECT rec_id, fid, fid || ':' || tag || ':' || v AS x, crc.t FROM fields, crc)")
def rec_checksum(spark, sf_dir):
    f = t.rec(spark, sf_dir).select("rec_id", F.explode("rec").alias("x"))
    return f.select("rec_id", "x.fid", checksum.show(records.field_checksum(F.col("x"))).alias("checksum"))


@query(f"SELECT o_orderkey AS rec_id, 'F1=' || o_orderkey || chr(10) || 'F12=' || o_custkey || chr(10) || 'F24=[' || {QUOTED} || ']' || chr(10) || 'F40=' || {NUM} || chr(10) || 'F50=' || o_orderstatus || chr(10) || 'F105=' || {DATE} AS canonical FROM orders")
def rec_canonical_text(spark, sf_dir):
    return t.rec(spark, sf_dir).select("rec_id", records.text(F.col("rec")).alias("canonical"))


@query(f"SELECT o_orderkey AS rec_id, '1=' || o_orderkey || ';12=' || o_custkey || ';24=[' || {QUOTED} || '];40=' || {NUM} || ';50=' || o_orderstatus || ';105=' || {DATE} AS short FROM orders")
def rec_shortform(spark, sf_dir):
    return t.rec(spark, sf_dir).select("rec_id", bridge.short_form(F.col("rec")).alias("short"))


def _explain_line(fid: int, tag: str, value: str, name: str | None) -> str:
    base = f"'F{fid}:{tag}=' || {value}"
    return base if name is None else f"{base} || repeat(' ', CASE WHEN strlen({base}) < 20 THEN 20 - strlen({base}) ELSE 2 END::BIGINT) || '# {name}'"


@query("SELECT o_orderkey AS rec_id, " + " || chr(10) || ".join([_explain_line(1, "i", "o_orderkey", "entity_id"), _explain_line(12, "i", "o_custkey", "user_id"), _explain_line(24, "sa", f"'[' || {QUOTED} || ']'", None), _explain_line(40, "f", NUM, "amount"), _explain_line(50, "s", "o_orderstatus", "status"), _explain_line(105, "i", f"({DATE})", None)]) + " AS explained FROM orders")
def rec_explain(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in t.NAMES.items() for x in kv])
    return t.rec(spark, sf_dir).select("rec_id", bridge.explained(F.col("rec"), names).alias("explained"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 16384 THEN 'StringTooLong' END AS error FROM documents")
def rec_limits(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents")
    rec = records.record((20, "s", F.col("text")), (21, "i", F.col("n_chars")))
    return d.select("doc_id", records.limit_error(rec).alias("error"))


@query("SELECT o_orderkey AS rec_id, 2 AS violations, FALSE AS ordered, 0 AS sorted_violations FROM orders")
def rec_order_violations(spark, sf_dir):
    r = F.col("rec")
    return t.rec(spark, sf_dir).select("rec_id", records.order_violations(r).alias("violations"), (records.order_violations(r) == 0).alias("ordered"), records.order_violations(records.sort(r)).alias("sorted_violations"))


@query("SELECT l_suppkey, l_returnflag, l_linestatus, min(l_orderkey) AS first_order, count(*) AS copies FROM lineitem GROUP BY ALL")
def rec_dedup(spark, sf_dir):
    li = t.table(spark, sf_dir, "lineitem").withColumn("rec", records.record((50, "s", F.col("l_returnflag")), (12, "i", F.col("l_suppkey")), (51, "s", F.col("l_linestatus"))))
    out = records.dedup(li.select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "rec"), "rec", "l_orderkey")
    return out.select("l_suppkey", "l_returnflag", "l_linestatus", F.col("l_orderkey").alias("first_order"), "copies")


@query("SELECT o_orderkey AS rec_id, o_custkey AS user_id, round(o_totalprice, 6) AS amount, o_orderstatus AS status, 5 AS n, TRUE AS equal FROM orders")
def rec_access(spark, sf_dir):
    r = F.col("rec")
    return t.rec(spark, sf_dir).select("rec_id", records.get(r, 12)["i"].alias("user_id"), _r(records.get(r, 40)["f"]).alias("amount"), records.get(r, 50)["s"].alias("status"), F.size(records.remove(r, 105)).alias("n"), records.canonical_equal(r, records.sort(r)).alias("equal"))


@query("SELECT o_orderkey AS rec_id, o_custkey AS user_id, o_orderstatus AS status FROM orders")
def rec_wide(spark, sf_dir):
    return records.wide(t.fields(spark, sf_dir), "rec_id", {12: ("user_id", "i"), 50: ("status", "s")})


@query("SELECT o_orderkey AS rec_id, 0 AS left_over, TRUE AS same FROM orders")
def rec_roundtrip(spark, sf_dir):
    """Records to the field table and back."""
    back = records.to_records(t.fields(spark, sf_dir), "rec_id").withColumnRenamed("rec", "back")
    return t.rec(spark, sf_dir).join(back, "rec_id").select("rec_id", (F.size("rec") - F.size("back")).alias("left_over"), (F.col("rec") == F.col("back")).alias("same"))


@query(f"WITH {FIELDS} SELECT rec_id, CASE WHEN fid = 50 AND v = 'F' THEN 'finished' WHEN fid = 50 AND v = 'O' THEN 'open' ELSE lower(v) END AS v FROM fields WHERE tag = 's'")
def dict_normalize(spark, sf_dir):
    eq = spark.createDataFrame(t.EQUIVALENCES, "fid int, from string, to string")
    f = t.fields(spark, sf_dir).where("tag = 's'")
    return registry.normalize_strings(f, eq, "lower").select("rec_id", F.col("s").alias("v"))


@query(f"SELECT l_orderkey, l_linenumber, regexp_replace((l_extendedprice / 4)::VARCHAR, '\\.0$', '') AS price, CASE WHEN l_tax = 0 THEN '0' ELSE regexp_replace(l_tax::VARCHAR, '\\.0$', '') END AS tax FROM lineitem")
def fmt_floats(spark, sf_dir):
    li = t.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", fmt.float_text(F.col("l_extendedprice") / 4).alias("price"), fmt.plain_float_text(-F.col("l_tax") * -1).alias("tax"))


# ================================================================ registry

VALID = """CASE WHEN f.fid > 32767 THEN 'Valid' WHEN r.fid IS NULL THEN 'Unknown' WHEN r.status = 'TOMBSTONED' THEN 'Tombstoned'
  WHEN r.expected <> CASE f.tag WHEN 'i' THEN 'Int' WHEN 'f' THEN 'Float' WHEN 's' THEN 'String' WHEN 'sa' THEN 'StringArray' END THEN 'TypeMismatch' WHEN r.status = 'DEPRECATED' THEN 'Deprecated' ELSE 'Valid' END"""


@query(f"WITH {REG_SQL}, {FIELDS} SELECT rec_id, f.fid, {VALID} AS result FROM fields f LEFT JOIN reg r ON f.fid = r.fid")
def reg_validate(spark, sf_dir):
    return registry.validate(t.fields(spark, sf_dir), t.registry(spark)).select("rec_id", "fid", "result")


@query(f"WITH {REG_SQL}, {FIELDS} SELECT result, count(*) AS n FROM (SELECT {VALID} AS result FROM fields f LEFT JOIN reg r ON f.fid = r.fid) WHERE result <> 'Valid' GROUP BY ALL")
def reg_invalid_counts(spark, sf_dir):
    return registry.invalid(t.fields(spark, sf_dir), t.registry(spark)).groupBy("result").agg(F.count("*").alias("n"))


@query(f"WITH {REG_SQL}, {FIELDS} SELECT rec_id, fid FROM fields WHERE fid NOT IN (SELECT fid FROM reg)")
def reg_unknown_anti(spark, sf_dir):
    return registry.unknown(t.fields(spark, sf_dir), t.registry(spark)).select("rec_id", "fid")


@query(f"WITH {REG_SQL} SELECT expected, status, count(*) AS n FROM reg GROUP BY ALL")
def reg_stats(spark, sf_dir):
    return registry.statistics(t.registry(spark))


@query(f"WITH {REG_SQL}, c AS (SELECT fid, unnest([CASE WHEN CASE WHEN fid <= 1023 THEN 'Core' WHEN fid <= 16383 THEN 'Standard' WHEN fid <= 32767 THEN 'Extended' ELSE 'Private' END <> range THEN 'RANGE' END, CASE WHEN NOT regexp_matches(name, '^[a-z][a-z0-9_]*$') THEN 'NAME' END]) AS problem FROM reg) SELECT * FROM c WHERE problem IS NOT NULL")
def reg_problems(spark, sf_dir):
    return registry.problems(t.registry(spark))


@query(f"WITH {REG_SQL}, a AS (SELECT fid FROM reg UNION ALL SELECT fid FROM reg WHERE fid % 2 = 0) SELECT fid, count(*) AS n FROM a GROUP BY fid HAVING count(*) > 1")
def reg_duplicates(spark, sf_dir):
    r = t.registry(spark)
    return registry.duplicates(r.unionAll(r.where("fid % 2 = 0")))


@query(f"""WITH {REG_SQL}, {REG_NEXT_SQL}, c AS (SELECT coalesce(o.fid, n.fid) AS fid, unnest([CASE WHEN n.fid IS NULL AND o.status <> 'TOMBSTONED' THEN 'REMOVED' END,
  CASE WHEN o.fid IS NOT NULL AND n.fid IS NOT NULL AND o.status <> 'TOMBSTONED' AND o.expected IS DISTINCT FROM n.expected THEN 'TYPE_CHANGE' END, CASE WHEN o.fid IS NOT NULL AND n.fid IS NOT NULL AND o.status <> 'TOMBSTONED' AND o.unit IS DISTINCT FROM n.unit THEN 'UNIT_CHANGE' END,
  CASE WHEN o.fid IS NOT NULL AND n.fid IS NOT NULL AND o.status <> 'TOMBSTONED' AND o.name IS DISTINCT FROM n.name THEN 'NAME_CHANGE' END, CASE WHEN o.status = 'TOMBSTONED' AND n.fid IS NOT NULL AND n.status <> 'TOMBSTONED' THEN 'TOMBSTONE_REUSE' END]) AS change
  FROM reg o FULL JOIN reg2 n ON o.fid = n.fid) SELECT * FROM c WHERE change IS NOT NULL""")
def reg_breaking_diff(spark, sf_dir):
    return registry.breaking_changes(t.registry(spark), t.registry(spark, t.REGISTRY_NEXT))


PEERS = [("a", "1.1.0"), ("b", "1.2.0"), ("c", "1.10.0"), ("d", None)]


@query(f"WITH {REG_SQL}, p(peer) AS (VALUES ('a'), ('d')) SELECT peer, fid, name FROM p, reg")
def rsy_delta(spark, sf_dir):
    return registry.delta_for_peers(spark.createDataFrame(PEERS, "peer string, version string"), t.registry(spark), "1.2.0")


@query("SELECT fid, CASE WHEN fid <= 255 THEN 'Core' WHEN fid <= 16383 THEN 'Standard' WHEN fid <= 32767 THEN 'Extended' ELSE 'Private' END AS range FROM (SELECT DISTINCT (o_orderkey * 7919 % 65536)::INTEGER AS fid FROM orders)")
def reg_ranges(spark, sf_dir):
    f = t.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919 % 65536).cast("int").alias("fid")).distinct()
    return f.select("fid", registry.fid_range(F.col("fid")).alias("range"))


# ================================================================ deltas and negotiation

DIFF = f"""{FIELDS}, {FIELDS_NEW}, ops AS (SELECT coalesce(o.rec_id, n.rec_id) AS rec_id, coalesce(o.fid, n.fid) AS fid,
  CASE WHEN o.fid IS NULL THEN 'Set' WHEN n.fid IS NULL THEN 'Delete' ELSE 'Update' END AS op, n.v AS v FROM fields o FULL JOIN fields2 n ON o.rec_id = n.rec_id AND o.fid = n.fid WHERE o.v IS DISTINCT FROM n.v)"""


def _ops(spark, sf_dir):
    show = lambda df: df.select("rec_id", F.explode("rec").alias("x")).select("rec_id", "x.fid", records.checksum_text(F.col("x")).alias("v"))
    old, new = show(t.rec(spark, sf_dir)), show(t.rec(spark, sf_dir, new=True))
    return old, new, delta.diff(old, new, ["rec_id", "fid"], "v")


@query(f"WITH {DIFF} SELECT rec_id, fid, op, v FROM ops")
def delta_diff(spark, sf_dir):
    return _ops(spark, sf_dir)[2]


@query(f"WITH {FIELDS_NEW} SELECT rec_id, fid, v, NULL::VARCHAR AS error FROM fields2")
def delta_apply(spark, sf_dir):
    old, _, ops = _ops(spark, sf_dir)
    return delta.apply(old, ops, ["rec_id", "fid"], "v")


@query(f"WITH {DIFF} SELECT fid, op, count(*) AS n FROM ops GROUP BY ALL")
def delta_op_counts(spark, sf_dir):
    return delta.op_counts(_ops(spark, sf_dir)[2], "fid")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def delta_latest(spark, sf_dir):
    return delta.latest(t.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id").drop("event_id")


@query(f"WITH {REG_SQL}, {REG_NEXT_SQL} SELECT reg.fid, reg.name AS local_name, reg2.name AS remote_name FROM reg JOIN reg2 USING (fid) WHERE reg.name <> reg2.name")
def neg_conflicts(spark, sf_dir):
    return negotiation.name_conflicts(t.registry(spark), t.registry(spark, t.REGISTRY_NEXT))


@query(f"WITH {REG_SQL}, {REG_NEXT_SQL} SELECT reg.fid, reg.expected, reg2.expected AS found FROM reg JOIN reg2 USING (fid) WHERE reg.expected <> reg2.expected ORDER BY 1")
def neg_type_mismatch(spark, sf_dir):
    return negotiation.type_mismatches(t.registry(spark), t.registry(spark, t.REGISTRY_NEXT))


@query(f"WITH {REG_SQL}, {REG_NEXT_SQL} SELECT DISTINCT fid FROM (SELECT fid FROM reg UNION SELECT fid FROM reg2 WHERE status = 'ACTIVE') WHERE fid NOT IN (SELECT fid FROM reg2 WHERE status = 'TOMBSTONED')")
def neg_agreed(spark, sf_dir):
    return negotiation.agreed(t.registry(spark), t.registry(spark, t.REGISTRY_NEXT))


@query("SELECT a.s_suppkey AS s_suppkey, (s_suppkey % 2 = 0 AND s_suppkey % 3 = 0) AS supports_nested, (s_suppkey % 5 = 0 OR s_suppkey % 7 = 0) AS requires_checksums FROM supplier a")
def neg_features(spark, sf_dir):
    s = F.col("s_suppkey")
    flags = lambda a, b: F.struct((s % a == 0).alias("supports_nested"), (s % b == 0).alias("requires_checksums"))
    both = negotiation.intersect_features(flags(2, 5), flags(3, 7), ["supports_nested", "requires_checksums"])
    return t.table(spark, sf_dir, "supplier").select("s_suppkey", both.alias("f")).select("s_suppkey", "f.*")


# ================================================================ envelopes and transport


def _env(spark, sf_dir):
    labels = F.create_map(F.lit("tenant"), F.concat(F.lit("t "), F.col("k").cast("string")), F.lit("Zone"), F.lit("eu"))
    env = F.struct("timestamp_ms", "source", F.concat(F.lit("abc-"), F.hex("event_id")).alias("trace_id"), F.col("event_id").alias("sequence"), labels.alias("labels"))
    return t.msg(spark, sf_dir).select("event_id", "kind", "priority", env.alias("env"))


LINE = """'#ENVELOPE timestamp=' || timestamp_ms || ' source=' || source || ' trace_id=abc-' || to_hex(event_id) || ' sequence=' || event_id || ' Zone=eu tenant="t ' || k || '"'"""


@query(f"WITH {MSG} SELECT event_id, {LINE} AS line FROM msg")
def env_text_header(spark, sf_dir):
    return _env(spark, sf_dir).select("event_id", transport.header_line(F.col("env")).alias("line"))


@query(f"WITH {MSG} SELECT event_id, timestamp_ms, source, 'abc-' || to_hex(event_id) AS trace_id, event_id AS sequence, 't ' || k AS tenant FROM msg")
def env_text_roundtrip(spark, sf_dir):
    back = transport.parse_header_line(transport.header_line(F.col("env")))
    return _env(spark, sf_dir).select("event_id", back.alias("b")).select("event_id", "b.timestamp_ms", "b.source", "b.trace_id", "b.sequence", F.col("b.labels")["tenant"].alias("tenant"))


HEXED = "regexp_replace('abc-' || to_hex(event_id), '[^0-9A-Fa-f]', '', 'g')"


@query(f"WITH {MSG} SELECT event_id, '00-' || rpad(lower({HEXED}), 32, '0') || '-0123456789abcdef-01' AS traceparent, rpad(lower({HEXED}), 32, '0') AS back FROM msg")
def http_traceparent(spark, sf_dir):
    p = transport.traceparent(F.col("env.trace_id"))
    return _env(spark, sf_dir).select("event_id", p.alias("traceparent"), transport.trace_id(p).alias("back"))


@query(f"WITH {MSG} SELECT event_id, 'svc' AS part, 7 AS n, timestamp_ms, event_id AS sequence, 't ' || k AS tenant, 'eu' AS zone FROM msg")
def http_headers(spark, sf_dir):
    h = transport.to_headers(F.col("env"), transport.HTTP)
    back = transport.from_headers(h, transport.HTTP)
    out = _env(spark, sf_dir).select("event_id", h.alias("h"), back.alias("b"))
    return out.select("event_id", F.substring("b.source", 1, 3).alias("part"), F.size("h").alias("n"), "b.timestamp_ms", "b.sequence", F.col("b.labels")["tenant"].alias("tenant"), F.col("b.labels")["zone"].alias("zone"))


@query(f"WITH {MSG} SELECT event_id, source, event_id AS sequence, 'eu' AS zone, kind, priority, {TTL}::BIGINT AS ttl_ms FROM msg")
def kafka_headers(spark, sf_dir):
    s = transport.KAFKA
    own = transport.message_headers(F.col("kind"), F.col("priority"), routing.default_ttl_ms(F.col("kind")), F.lit(None).cast("string"), s)
    sent = transport.kafka_headers(F.map_concat(transport.to_headers(F.col("env"), s), own))
    got = _env(spark, sf_dir).select("event_id", transport.from_kafka_headers(sent).alias("h"))
    got = got.select("event_id", transport.from_headers(F.col("h"), s).alias("e"), transport.message_of_headers(F.col("h"), s).alias("m"))
    return got.select("event_id", "e.source", "e.sequence", F.col("e.labels")["Zone"].alias("zone"), "m.kind", "m.priority", "m.ttl_ms")


@query(f"WITH {MSG} SELECT event_id, timestamp_ms, source, 'abc-' || to_hex(event_id) AS trace_id, event_id AS sequence FROM msg")
def tlv_roundtrip(spark, sf_dir):
    data = _env(spark, sf_dir).select("event_id", binary.envelope_bytes(F.col("env")).alias("data"))
    return binary.decode_envelope(data, "data", "event_id").select("event_id", "envelope.*")


@query("SELECT doc_id, CASE WHEN strlen(text) > 256 THEN 'SourceTooLong' END AS error FROM documents")
def env_validate(spark, sf_dir):
    env = F.struct(F.col("text").alias("source"), F.col("lang").alias("trace_id"))
    return t.table(spark, sf_dir, "documents").select("doc_id", transport.envelope_error(env).alias("error"))


# ================================================================ prompts


@query(f"""WITH nested AS (SELECT o_orderkey AS rec_id, '100.12' AS path, o_custkey::VARCHAR AS v FROM orders UNION ALL SELECT l_orderkey, '101.' || row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) || '.7', l_partkey::VARCHAR FROM lineitem)
  SELECT * FROM nested""")
def llb_flatten(spark, sf_dir):
    """Orders with a nested customer (field 100) and an array of line records (field 101), flattened to paths."""
    none = [F.lit(None).cast(kind).alias(k) for k, kind in records.TYPES.items() if k != "i"]
    row = lambda path, fid, tag, v: [path.cast("array<int>").alias("path"), F.lit(0).alias("pos"), F.lit(fid).alias("fid"), F.lit(tag).alias("tag"), v.cast("long").alias("i"), *none]
    o, li = t.table(spark, sf_dir, "orders"), t.table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey").alias("rec_id")
    top = o.select(key, *row(F.array(), 100, "r", F.lit(None))).unionByName(o.select(key, *row(F.array(F.lit(100)), 12, "i", F.col("o_custkey"))))
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*t.LINE[1:]))
    lines = li.select(F.col("l_orderkey").alias("rec_id"), n.alias("n"), "l_partkey").select("rec_id", *row(F.array(F.lit(101), F.col("n")), 7, "i", F.col("l_partkey")))
    return bridge.flatten(top.unionByName(lines), "rec_id").select("rec_id", F.col("path_text").alias("path"), F.col("i").cast("string").alias("v"))


@query("""WITH b AS (SELECT p_partkey, p_name, CASE WHEN strlen(p_name) = 0 THEN 'x' WHEN strlen(p_name) <= 3 THEN lower(p_name) ELSE lower(left(p_name, 1)) || strlen(p_name) END AS base FROM part)
  SELECT p_partkey, base, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || (row_number() OVER w - 1) END AS short_id, count(*) OVER (PARTITION BY base) > 1 AS collides FROM b WINDOW w AS (PARTITION BY base ORDER BY p_partkey)""")
def llb_short_ids(spark, sf_dir):
    return bridge.short_ids(t.table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "base", "short_id", "collides")


@query(f"SELECT o_orderkey AS rec_id, 'F1=' || o_orderkey || ' # entity_id@sem' || chr(10) || 'F12=' || o_custkey || ' # user_id@sem' || chr(10) || 'F24=[' || {QUOTED} || ']' || chr(10) || 'F40=' || {NUM} || ' # amount@sem' || chr(10) || 'F50=' || o_orderstatus || ' # status@sem' || chr(10) || 'F105=' || {DATE} AS hinted FROM orders")
def llb_hints(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for kv in t.NAMES.items() for x in kv])
    return t.rec(spark, sf_dir).select("rec_id", bridge.hinted(F.col("rec"), names).alias("hinted"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = '' OR regexp_matches(c_mktsegment, '^[0-9]|[ \\t\\n\\r,;\\[\\]{}"\\\\#=]') THEN '"' || c_mktsegment || '"' ELSE c_mktsegment END AS segment FROM customer""")
def llb_prompt(spark, sf_dir):
    return t.table(spark, sf_dir, "customer").select("c_custkey", bridge.prompt_string(F.col("c_mktsegment")).alias("segment"))


@query("SELECT fid, CASE WHEN fid >= 256 THEN fid >> 8 END::INTEGER AS base, CASE WHEN fid >= 256 THEN fid & 255 ELSE fid END::INTEGER AS leaf FROM (SELECT DISTINCT (o_orderkey * 7919 % 65536)::INTEGER AS fid FROM orders)")
def llb_unflatten(spark, sf_dir):
    f = t.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919 % 65536).cast("int").alias("fid")).distinct()
    return f.select("fid", bridge.unflatten(F.col("fid")).alias("u")).select("fid", "u.*")


# ================================================================ space


@query(f"WITH {POS}, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM pos WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINE_SQL})) SELECT l_orderkey, l_linenumber, round(sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2), 6) AS distance FROM p")
def spa_distance(spark, sf_dir):
    before = F.lag("p").over(W.partitionBy("l_orderkey").orderBy(*t.LINE[1:]))
    return t.pos(spark, sf_dir).withColumn("q", before).select("l_orderkey", "l_linenumber", _r(spatial.distance(F.col("p"), F.col("q"))).alias("distance"))


TURNED = """{POS}, a AS (SELECT *, x * 2e0 AS sx, y * 1e0 AS sy, z * 0.5e0 AS sz FROM pos), b AS (SELECT *, sx * cos(0.3e0) - sy * sin(0.3e0) AS bx, sx * sin(0.3e0) + sy * cos(0.3e0) AS b_y FROM a),
  c AS (SELECT *, bx * cos(0.2e0) + sz * sin(0.2e0) AS cx, sz * cos(0.2e0) - bx * sin(0.2e0) AS cz FROM b)""".replace("{POS}", POS)


@query(f"WITH {TURNED} SELECT l_orderkey, l_linenumber, round(cx + 1, 6) AS x, round(b_y * cos(0.1e0) - cz * sin(0.1e0) + 2, 6) AS y, round(b_y * sin(0.1e0) + cz * cos(0.1e0) + 3, 6) AS z FROM c")
def spa_transform(spark, sf_dir):
    three = lambda names, v: F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v, strict=True)])
    q = spatial.transform(F.col("p"), three(spatial.TURNS, (0.1, 0.2, 0.3)), three(spatial.AXES, (1.0, 2.0, 3.0)), three(spatial.AXES, (2.0, 1.0, 0.5)))
    return t.pos(spark, sf_dir).select("l_orderkey", "l_linenumber", q.alias("q")).select("l_orderkey", "l_linenumber", *[_r(f"q.{n}").alias(n) for n in spatial.AXES])


@query("""WITH b AS (SELECT l_orderkey, l_extendedprice - 2 AS x0, l_extendedprice + 2 AS x1, l_quantity - 1 AS y0, l_quantity + 1 AS y1, l_suppkey - 20 AS z0, l_suppkey + 20 AS z1, floor(l_extendedprice / 8)::BIGINT AS c FROM lineitem),
  n AS (SELECT b.*, c + d AS near FROM b, (VALUES (-1), (0), (1)) v(d))
  SELECT a.l_orderkey AS a, n.l_orderkey AS b, count(*) AS n FROM b a JOIN n ON a.c = n.near AND a.l_orderkey < n.l_orderkey AND a.x0 <= n.x1 AND a.x1 >= n.x0 AND a.y0 <= n.y1 AND a.y1 >= n.y0 AND a.z0 <= n.z1 AND a.z1 >= n.z0 GROUP BY 1, 2""")
def spa_bbox_join(spark, sf_dir):
    """Orders that have lines whose boxes meet, over all lines."""
    li = t.spread(t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_suppkey"))
    at = {"x": (F.col("l_extendedprice"), 2), "y": (F.col("l_quantity"), 1), "z": (F.col("l_suppkey"), 20)}
    corner = lambda sign: F.struct(*[(v + sign * w).alias(n) for n, (v, w) in at.items()])
    boxes = li.select("l_orderkey", F.struct(corner(-1).alias("min"), corner(1).alias("max")).alias("box"))
    met = spatial.boxes_joined(boxes, "box", (16.0, 8.0, 160.0), F.col("a.l_orderkey") < F.col("b.l_orderkey"))
    return met.groupBy(F.col("a.l_orderkey").alias("a"), F.col("b.l_orderkey").alias("b")).agg(F.count("*").alias("n"))


STEPS = f"{POS}, p AS (SELECT *, row_number() OVER w - 1 AS seq, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM pos WINDOW w AS (PARTITION BY l_orderkey ORDER BY {LINE_SQL}))"


def _steps(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy(*t.LINE[1:])
    return t.pos(spark, sf_dir).withColumns({"q": F.lag("p").over(w), "seq": (F.row_number().over(w) - 1).cast("long")})


@query(f"WITH {STEPS} SELECT l_orderkey, l_linenumber, round(x - px, 6) AS dx, round(y - py, 6) AS dy, round(z - pz, 6) AS dz FROM p")
def spa_delta(spark, sf_dir):
    d = spatial.difference(F.col("q"), F.col("p"))
    return _steps(spark, sf_dir).select("l_orderkey", "l_linenumber", *[_r(d[n]).alias("d" + n) for n in spatial.AXES])


@query(f"WITH {STEPS} SELECT l_orderkey, seq, CASE WHEN seq % 3 = 0 OR px IS NULL THEN 'ABS' ELSE 'DELTA' END AS mode FROM p")
def spa_sender_modes(spark, sf_dir):
    return _steps(spark, sf_dir).select("l_orderkey", "seq", spatial.sender_mode(F.col("seq"), F.col("q").isNotNull(), 3).alias("mode"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'PositionOutOfRange' WHEN sqrt(o_custkey::DOUBLE ** 2 + 2) > 100 THEN 'SpeedTooHigh' END AS error FROM orders")
def spa_validate(spark, sf_dir):
    p = spatial.position(F.col("o_totalprice"), F.lit(0), F.lit(0))
    v = spatial.position(F.col("o_custkey"), F.lit(1), F.lit(1))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", spatial.state_error(p, v).alias("error"))


def _frames(spark, sf_dir):
    s = _steps(spark, sf_dir)
    mode = spatial.sender_mode(F.col("seq"), F.col("q").isNotNull(), 100)
    sent = F.when(mode == "ABS", F.col("p")).otherwise(spatial.difference(F.col("q"), F.col("p")))
    none = F.lit(None).cast("double")
    return s.select("l_orderkey", "seq", mode.alias("mode"), sent["x"].alias("x"), sent["y"].alias("y"), sent["z"].alias("z"), none.alias("vx"), none.alias("vy"), none.alias("vz"), F.lit(True).alias("ok"))


@query(f"WITH {STEPS} SELECT l_orderkey, seq, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, FALSE AS predicted, NULL::VARCHAR AS error FROM p")
def spa_receiver(spark, sf_dir):
    """Sent frames, received again: every order is a stream."""
    out = receiver.run_batch(_frames(spark, sf_dir), "l_orderkey", "seq", receiver.receive, receiver.STATE_OUT)
    return out.select("l_orderkey", "seq", *[_r(n, 4).alias(n) for n in spatial.AXES], "predicted", "error")


# ================================================================ text and bytes


@query(r"SELECT doc_id, regexp_replace(text, '[ \t]+(\r?\n|$)', '\1', 'g') AS clean FROM documents")
def san_minimal(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[ \t]+(?=\r?\n|\z)", "").alias("clean"))


@query(f"WITH {MSG} SELECT event_id, 'F1=1;F2=0;F3=\"a b ' || k || '\";F4=' || (event_id % 50) || chr(10) AS clean FROM msg")
def san_repair(spark, sf_dir):
    """Broken record text, repaired."""
    bad = F.concat(F.lit(" F1=yes ;  F2=No ; F3=a b "), F.col("k").cast("string"), F.lit(" ;F4=00"), (F.col("event_id") % 50).cast("string"), F.lit("  \n"))
    return text.sanitize_column(t.msg(spark, sf_dir).select("event_id", bad.alias("clean")), "clean", level="aggressive", numbers=True)


#: Text is read as it is: an unquoted item that begins with a digit is no string, and a whole number is no float.
READ_ERROR = "CASE WHEN regexp_matches(o_orderpriority, '^[0-9][A-Za-z0-9_.-]*$') THEN 'UnexpectedToken' WHEN o_totalprice = floor(o_totalprice) THEN 'TypeHintMismatch' END"


@query(f"""SELECT rec_id, CASE WHEN error IS NULL THEN 6 END AS n, CASE WHEN error IS NULL THEN canonical END AS canonical, error FROM (SELECT o_orderkey AS rec_id, {READ_ERROR} AS error,
  'F1=' || o_orderkey || chr(10) || 'F12=' || o_custkey || chr(10) || 'F24=[' || {QUOTED} || ']' || chr(10) || 'F40=' || {NUM} || chr(10) || 'F50=' || o_orderstatus || chr(10) || 'F105=' || {DATE} AS canonical FROM orders)""")
def text_parse(spark, sf_dir):
    """Records written with hints and checksums, read and checked again."""
    written = t.rec(spark, sf_dir).select("rec_id", records.text(F.col("rec"), hints=True, checksums=True).alias("text"))
    got = text.parse(written, "text", "rec_id", options=text.Options(normalize=False, validate_checksums=True))
    return got.select("rec_id", F.size("fields").alias("n"), "canonical", F.col("error.class").alias("error"))


@query("SELECT o_orderkey AS rec_id, CASE o_orderkey % 4 WHEN 0 THEN 'TypeHintMismatch' WHEN 1 THEN 'InvalidFieldId' WHEN 2 THEN 'UnterminatedString' END AS error FROM orders")
def text_errors(spark, sf_dir):
    key = F.col("o_orderkey")
    bad = F.when(key % 4 == 0, "F12:i=abc").when(key % 4 == 1, "F70000=1").when(key % 4 == 2, 'F1="open').otherwise("F1=ok")
    got = text.parse(t.table(spark, sf_dir, "orders").select(key.alias("rec_id"), bad.alias("text")), "text", "rec_id")
    return got.select("rec_id", F.col("error.class").alias("error"))


@query(f"SELECT o_orderkey AS rec_id, 'F1=' || o_orderkey || chr(10) || 'F12=' || o_custkey || chr(10) || 'F24=[' || {QUOTED} || ']' || chr(10) || 'F40=' || {NUM} || chr(10) || 'F50=' || o_orderstatus || chr(10) || 'F105=' || {DATE} AS canonical, 4 AS version FROM orders")
def bin_roundtrip(spark, sf_dir):
    frames = binary.encode_column(t.rec(spark, sf_dir), "rec", "rec_id")
    back = binary.decode_to_text(frames.select("rec_id", "frame", binary.version(F.col("frame")).alias("version")), "frame", "rec_id", "version")
    return back.select("rec_id", "canonical", "version")


@query("SELECT o_orderkey AS rec_id, o_custkey AS user_id FROM orders")
def bin_selective(spark, sf_dir):
    """One field of a frame, the others passed over."""
    frames = binary.encode_column(t.rec(spark, sf_dir), "rec", "rec_id")
    got = binary.decode_column(frames, "frame", "rec_id", only={12})
    return got.select("rec_id", F.get("fields", F.lit(0))["i"].alias("user_id"))


@query("""WITH h AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0e0 ELSE round_even(x / (2e0 ** (greatest(floor(log2(abs(x))), -14) - 10)), 0) * (2e0 ** (greatest(floor(log2(abs(x))), -14) - 10)) END) AS h FROM embeddings)
  SELECT vec_id, round(list_sum(h), 6) AS total, round(h[1], 6) AS first, round(h[64], 6) AS last FROM h""")
def fp16_roundtrip(spark, sf_dir):
    back = t.vec(spark, sf_dir).select("vec_id", "embedding", binary.half_floats(F.col("embedding")).alias("h")).withColumn("b", binary.from_half_floats(F.col("h")))
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", _r(total).alias("total"), *[_r(F.get("b", F.lit(k)).cast("double")).alias(c) for k, c in ((0, "first"), (63, "last"))])


@query("SELECT doc_id, sha256(text) AS sha, strlen(text) AS total_bytes, NULL::VARCHAR AS error FROM documents")
def chunk_reassemble(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    out = chunks.reassemble(chunks.split(d, "payload", "doc_id", chunk=1024), "doc_id")
    return out.select("doc_id", F.sha2("payload", 256).alias("sha"), "total_bytes", "error")


@query("""WITH f AS (SELECT conv_id, turn, strlen(text) AS n FROM conversations), s AS (SELECT conv_id, turn, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS in_flight FROM f)
  SELECT conv_id, turn, in_flight, in_flight < 1000 AS can_send FROM s""")
def chunk_flow(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n"))
    return chunks.in_flight(c, "n", "turn", "conv_id", window=1000).select("conv_id", "turn", "in_flight", "can_send")


@query("SELECT conv_id, turn AS seq, CASE WHEN turn = 0 THEN 'StreamStarted' ELSE 'ChunkReceived' END AS event, NULL::VARCHAR AS error FROM conversations")
def chunk_receiver(spark, sf_dir):
    c = t.table(spark, sf_dir, "conversations")
    frames = c.select("conv_id", F.col("turn").alias("seq"), F.when(F.col("turn") == 0, "Begin").otherwise("Chunk").alias("kind"), F.octet_length("text").cast("long").alias("size"), F.lit(True).alias("ok"))
    return receiver.run_batch(frames, "conv_id", "seq", receiver.chunk, receiver.CHUNK_OUT).select("conv_id", "seq", "event", "error")


@query("""SELECT s_suppkey AS peer, unnest(range(5)) AS seq, unnest(['CapabilitiesSent', 'CapabilitiesReceived', 'SchemaSelected', 'Ready', 'Ready']) AS state, unnest([NULL, NULL, NULL, NULL, 'InvalidState']) AS error FROM supplier""")
def neg_handshake(spark, sf_dir):
    log = F.array(*[F.struct(F.lit(k).cast("long").alias("seq"), F.lit(m).alias("message")) for k, m in enumerate(("Initiate", "CapabilitiesAck", "SelectSchema", "Ready", "SelectSchema"))])
    m = t.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("peer"), F.inline(log))
    return receiver.run_batch(m, "peer", "seq", receiver.handshake, receiver.MESSAGE_OUT).select("peer", "seq", "state", "error")


@query("SELECT p_partkey, 'Text' AS mode, 1::BIGINT AS version, 0::BIGINT AS flags, 4::BIGINT AS metadata_length, CASE WHEN p_partkey % 3 = 0 THEN 'InvalidMagic' WHEN p_partkey % 3 = 1 THEN 'TruncatedMetadata' END AS error FROM part")
def container_header(spark, sf_dir):
    magic = F.when(F.col("p_partkey") % 3 == 0, F.lit("00000000")).otherwise(F.lit(container.MAGIC.hex()))
    tail = F.when(F.col("p_partkey") % 3 == 1, F.lit("00")).otherwise(F.lit("0000000000"))
    data = F.unhex(F.concat(magic, F.lit("0101000000000004"), tail))
    return t.table(spark, sf_dir, "part").select("p_partkey", container.header(data).alias("h")).select("p_partkey", "h.*")


from . import codec_queries  # noqa: E402, F401  it adds its own
