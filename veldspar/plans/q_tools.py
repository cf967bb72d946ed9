"""Queries of search, vectors, maps, versions and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veldspar.operators import geo as G
from veldspar.operators import opsmetrics as O
from veldspar.operators import profile as P
from veldspar.operators import records as R
from veldspar.operators import search as S
from veldspar.operators import vector as X
from veldspar.operators import versions as W
from veldspar.operators import workspace as WS
from veldspar.plans.catalog import query
from veldspar.plans.q_records import read
from veldspar.streaming import ops as ST

QUERY = "the inging than"
TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda t: length(t) >= 2)"


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def _bm25_sql(query_text: str, where: str, out: str, limit: int = 100) -> str:
    words = S.query_tokens(query_text)
    distinct = list(dict.fromkeys(words))
    cols = [f"len({TOK.format(f)}) AS len_{f}" for f in ("text", "source")]
    cols += [f"len(list_filter({TOK.format(f)}, lambda t: t = '{w}')) AS tf_{f}_{k}" for f in ("text", "source") for k, w in enumerate(distinct)]
    stats = ["count(*) AS n"] + [f"sum(len_{f}) AS total_{f}" for f in ("text", "source")] + [f"count(*) FILTER (tf_{f}_{k} > 0) AS df_{f}_{k}" for f in ("text", "source") for k in range(len(distinct))]
    parts = []
    for f in ("text", "source"):
        terms = []
        for w in words:
            k = distinct.index(w)
            terms.append(f"CASE WHEN tf_{f}_{k} > 0 THEN ln((n - df_{f}_{k} + 0.5::DOUBLE) / (df_{f}_{k} + 0.5::DOUBLE) + 1) * tf_{f}_{k} * 2.2::DOUBLE / (tf_{f}_{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len_{f} / (total_{f}::DOUBLE / n))) ELSE 0 END")
        parts.append(f"({' + '.join(terms)}) AS score_{f}")
    has = " AND ".join(f"(tf_text_{k} > 0 OR tf_source_{k} > 0)" for k in range(len(distinct)))
    cond = {"any": "true", "all": has, "phrase": f"(contains(lower(text), '{query_text.lower()}') OR contains(lower(source), '{query_text.lower()}'))"}[where]
    return f"""WITH slim AS (SELECT doc_id, text, source, lang, {', '.join(cols)} FROM documents), stats AS (SELECT {', '.join(stats)} FROM slim),
scored AS (SELECT *, score_text + score_source AS score FROM (SELECT doc_id, text, source, lang, {', '.join(c.split(' AS ')[1] for c in cols if ' AS tf_' in c)}, {', '.join(parts)} FROM slim, stats)),
hits AS (SELECT * FROM scored WHERE score > 0 AND {cond}), best AS (SELECT * FROM hits ORDER BY round(score, 9) DESC, doc_id LIMIT {limit})
{out}"""


def _top(df):
    return df.withColumn("score", F.round("score", 9)).orderBy(F.col("score").desc(), "doc_id").limit(S.LIMIT)


@query(_bm25_sql(QUERY, "any", "SELECT doc_id, round(score, 6) AS score FROM best"))
def bm25_any(spark, sf_dir):
    return _top(S.score(_docs(spark, sf_dir), "doc_id", ["text", "source"], QUERY)).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(QUERY, "all", "SELECT doc_id, round(score, 6) AS score FROM best"))
def bm25_all(spark, sf_dir):
    return _top(S.score(_docs(spark, sf_dir), "doc_id", ["text", "source"], QUERY, "all")).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("of the", "phrase", "SELECT doc_id, round(score, 6) AS score FROM best"))
def bm25_phrase(spark, sf_dir):
    return _top(S.score(_docs(spark, sf_dir), "doc_id", ["text", "source"], "of the", "phrase")).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("the src3 the", "any", "SELECT doc_id, round(score_text, 6) AS score_text, round(score_source, 6) AS score_source FROM best"))
def bm25_field_scores(spark, sf_dir):
    return _top(S.score(_docs(spark, sf_dir), "doc_id", ["text", "source"], "the src3 the")).select("doc_id", F.round("score_text", 6).alias("score_text"), F.round("score_source", 6).alias("score_source"))


@query(f"SELECT field, term, doc_id, count(*) AS tf FROM (SELECT doc_id, 'text' AS field, unnest({TOK.format('text')}) AS term FROM documents UNION ALL SELECT doc_id, 'source', unnest({TOK.format('source')}) FROM documents) GROUP BY ALL")
def bm25_postings(spark, sf_dir):
    return S.postings(_docs(spark, sf_dir), "doc_id", ["text", "source"])


def _indexed(spark, sf_dir, query_text, mode="any"):
    docs = _docs(spark, sf_dir)
    index = S.write_index(docs, "doc_id", ["text", "source"])
    return _top(S.score_index(index, query_text, mode, docs, "doc_id").withColumnRenamed("id", "doc_id"))


@query(_bm25_sql(QUERY, "any", "SELECT doc_id, round(score, 6) AS score FROM best"))
def bm25_index_any(spark, sf_dir):
    return _indexed(spark, sf_dir, QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql(QUERY, "all", "SELECT doc_id, round(score, 6) AS score FROM best"))
def bm25_index_all(spark, sf_dir):
    return _indexed(spark, sf_dir, QUERY, "all").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("of the", "phrase", "SELECT doc_id, round(score, 6) AS score FROM best"))
def bm25_index_phrase(spark, sf_dir):
    return _indexed(spark, sf_dir, "of the", "phrase").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25_sql("the src3 the", "any", "SELECT doc_id, round(score_text, 6) AS score_text, round(score_source, 6) AS score_source FROM best"))
def bm25_index_fields(spark, sf_dir):
    return _indexed(spark, sf_dir, "the src3 the").select("doc_id", F.round("score_text", 6).alias("score_text"), F.round("score_source", 6).alias("score_source"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {TOK.format('text')} AS t FROM documents)")
def text_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(_bm25_sql(QUERY, "any", """, long AS (SELECT 'source' AS field, source AS value FROM hits UNION ALL SELECT 'lang', lang FROM hits), counts AS (SELECT field, value, count(*) AS count FROM long GROUP BY ALL)
SELECT field, value, count FROM (SELECT *, count(*) OVER (PARTITION BY field) AS vals FROM counts) WHERE vals > 1 AND vals <= 50 AND vals / (SELECT count(*) FROM hits) < 0.5"""))
def search_facets(spark, sf_dir):
    return S.facets(S.score(_docs(spark, sf_dir), "doc_id", ["text", "source"], QUERY), ["source", "lang"])


@query(_bm25_sql(QUERY, "any", "SELECT doc_id FROM hits WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2', 'src3')"))
def search_facet_filter(spark, sf_dir):
    return S.facet_filter(S.score(_docs(spark, sf_dir), "doc_id", ["text", "source"], QUERY), {"lang": ["en", "de"], "source": ["src1", "src2", "src3"], "other": []}).select("doc_id")


def _ranges_sql(query_text: str) -> str:
    parts = []
    for t in dict.fromkeys(S.query_tokens(query_text)):
        p = t.translate(str.maketrans(S.MARKED, S.PLAIN))
        parts.append(f"""SELECT doc_id, '{t}' AS token, (list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * {len(p)})::INT AS s, {len(p)} AS w
FROM (SELECT doc_id, g, unnest(range(1, len(g))) AS i FROM (SELECT doc_id, string_split(translate(lower(text), '{S.MARKED}', '{S.PLAIN}'), '{p}') AS g FROM documents))""")
    return f"WITH r AS ({' UNION ALL '.join(parts)}) "


@query(_ranges_sql("élan tion") + "SELECT doc_id, token, s AS start, s + w AS end FROM r")
def search_ranges(spark, sf_dir):
    return S.match_ranges(_docs(spark, sf_dir), "doc_id", "text", "élan tion")


@query(_ranges_sql("tion onan ion") + """, m AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY s, e) AS run FROM (SELECT doc_id, s, s + w AS e, CASE WHEN s > max(s + w) OVER (PARTITION BY doc_id ORDER BY s, s + w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY doc_id ORDER BY s, s + w) = 1 THEN 1 ELSE 0 END AS o FROM r))
SELECT doc_id, min(s) AS start, max(e) AS end FROM m GROUP BY doc_id, run""")
def search_highlight(spark, sf_dir):
    return S.merged_ranges(S.match_ranges(_docs(spark, sf_dir), "doc_id", "text", "tion onan ion"), "doc_id")


# -- vectors

_E = "embedding::DOUBLE[]"
_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


@query(f"SELECT vec_id, round(list_cosine_similarity({_E}, {_Q}), 8) AS score FROM embeddings WHERE vec_id <> 7 ORDER BY list_cosine_similarity({_E}, {_Q}) DESC, vec_id LIMIT 5")
def vector_knn_cosine(spark, sf_dir):
    return X.nearest(_vectors(spark, sf_dir), "vec_id", "embedding", 7).withColumn("score", F.round("score", 8))


@query(f"SELECT vec_id, round(1 / (1 + list_distance({_E}, {_Q})), 8) AS score FROM embeddings WHERE vec_id <> 7 ORDER BY list_distance({_E}, {_Q}), vec_id LIMIT 10")
def vector_knn_euclid(spark, sf_dir):
    return X.nearest(_vectors(spark, sf_dir), "vec_id", "embedding", 7, 10, "euclid").withColumn("score", F.round("score", 8))


@query(f"SELECT vec_id, len(embedding) AS dimensions, round(list_sum(({_E})[1:8]), 6) AS first8, list_min({_E}) AS min, list_max({_E}) AS max, round(list_avg({_E}), 8) AS mean FROM embeddings")
def vector_stats(spark, sf_dir):
    out = X.stats(_vectors(spark, sf_dir), "vec_id", "embedding")
    return out.withColumn("first8", F.round(F.aggregate("first", F.lit(0.0), lambda s, x: s + x), 6)).drop("first").withColumn("mean", F.round("mean", 8))


@query("SELECT vec_id, 'other length' AS problem FROM embeddings WHERE vec_id % 50 = 3 UNION ALL SELECT vec_id, 'empty' FROM embeddings WHERE vec_id % 50 = 4")
def vector_validate(spark, sf_dir):
    broken = F.when(F.col("vec_id") % 50 == 3, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 50 != 4, F.col("embedding"))
    return X.problems(_vectors(spark, sf_dir).withColumn("embedding", broken), "vec_id", "embedding")


@query("SELECT vec_id, label, ((dense_rank() OVER (ORDER BY label) - 1) % 12)::INT AS color FROM embeddings")
def vector_color(spark, sf_dir):
    return X.colors(_vectors(spark, sf_dir), "vec_id", "label")


@query()
def vector_pca(spark, sf_dir):
    return X.pca(_vectors(spark, sf_dir), "vec_id", "embedding")


# -- maps

_LAT, _LON = "((s_suppkey * 37 % 180) - 90 + 0.5::DOUBLE)", "((s_suppkey * 53 % 360) - 180)::DOUBLE"


def _points(spark, sf_dir):
    return G.points(read(spark, sf_dir, "supplier"), F.expr("(s_suppkey * 37 % 180) - 90 + 0.5D"), F.expr("(s_suppkey * 53 % 360) - 180"))


def _haversine(lat: float, lon: float) -> str:
    return f"2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - {lat}::DOUBLE) / 2), 2) + cos(radians({lat}::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - {lon}::DOUBLE) / 2), 2))))"


_P = f"(SELECT s_suppkey, s_name, {_LAT} AS lat, {_LON} AS lon FROM supplier)"


@query(f"SELECT s_suppkey, round({_haversine(35.68, 139.69)}, 2) AS distance FROM {_P} ORDER BY {_haversine(35.68, 139.69)}, s_suppkey LIMIT 5")
def geo_knn(spark, sf_dir):
    return G.nearest(_points(spark, sf_dir), "s_suppkey", 35.68, 139.69).withColumn("distance", F.round("distance", 2))


@query(f"SELECT s_suppkey, round({_haversine(10.0, 20.0)}, 2) AS distance FROM {_P} WHERE {_haversine(10.0, 20.0)} <= 5000000")
def geo_radius(spark, sf_dir):
    return G.within(_points(spark, sf_dir), "s_suppkey", 10.0, 20.0, 5_000_000).withColumn("distance", F.round("distance", 2))


@query(f"SELECT (min(lat) + max(lat)) / 2 AS center_lat, (min(lon) + max(lon)) / 2 AS center_lon, greatest((max(lat) - min(lat)) * 1.2::DOUBLE, 0.01) AS span_lat, greatest((max(lon) - min(lon)) * 1.2::DOUBLE, 0.01) AS span_lon FROM {_P}")
def geo_bounds(spark, sf_dir):
    return G.bounds(_points(spark, sf_dir))


@query(f"SELECT s_suppkey, lat, lon FROM {_P} WHERE s_suppkey % 3 <> 0")
def geo_points(spark, sf_dir):
    return G.points(read(spark, sf_dir, "supplier"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 'north' ELSE CAST((s_suppkey * 37 % 180) - 90 + 0.5D AS STRING) END"), F.expr("(s_suppkey * 53 % 360) - 180")).select("s_suppkey", "lat", "lon")


@query("SELECT s_suppkey, CASE WHEN s_suppkey * 17 < 1000 THEN printf('%.0f m', (s_suppkey * 17)::DOUBLE) ELSE printf('%.1f km', s_suppkey * 17 / 1000) END AS shown FROM supplier")
def fmt_distance(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", G.distance_text((F.col("s_suppkey") * 17).cast("double")).alias("shown"))


# -- versions

_VERSIONS = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type, round(value)::BIGINT::VARCHAR AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was_type, lag(round(value)::BIGINT::VARCHAR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was_value FROM events)"
_CHANGE = "CASE WHEN version = 1 THEN 'added' WHEN {0} = {1} THEN 'unchanged' ELSE 'modified' END"
_HISTORY = f"SELECT user_id, version, 'event_type' AS field, {_CHANGE.format('event_type', 'was_type')} AS change, was_type AS before, event_type AS after FROM {_VERSIONS} UNION ALL SELECT user_id, version, 'value', {_CHANGE.format('value', 'was_value')}, was_value, value FROM {_VERSIONS}"


def _versions(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    snapshot = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("value"), F.round("value").cast("bigint").cast("string"))
    return read(spark, sf_dir, "events").select("user_id", F.row_number().over(by).cast("bigint").alias("version"), snapshot.alias("snapshot"))


@query(_HISTORY)
def diff_history(spark, sf_dir):
    return W.history(_versions(spark, sf_dir), "user_id", "version", "snapshot")


@query(f"SELECT * FROM ({_HISTORY}) WHERE change <> 'unchanged'")
def diff_changes_only(spark, sf_dir):
    return W.changes_only(W.history(_versions(spark, sf_dir), "user_id", "version", "snapshot"))


@query(f"SELECT user_id, version, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified FROM ({_HISTORY}) GROUP BY ALL")
def diff_summary(spark, sf_dir):
    return W.summary(W.history(_versions(spark, sf_dir), "user_id", "version", "snapshot"), "user_id", "version")


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'modified' END AS change, a.v AS before, b.v AS after
FROM (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 1) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 7 <> 2) b USING (c_custkey)""")
def diff_snapshots(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("v"))
    new = rows.where("c_custkey % 7 <> 2").withColumn("v", F.when(F.col("c_custkey") % 5 == 0, F.lower("v")).otherwise(F.col("v")))
    return W.snapshot_diff(rows.where("c_custkey % 7 <> 1"), new, "c_custkey", "v")


# -- metrics and declared index kinds


def _log(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type", (F.col("event_type") == "error").alias("failed"))


@query("""SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS successes, (count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 60 SECOND))::DOUBLE / 60 AS ops_per_second, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate,
list_sort(list(value))[1 + least(floor(count(*) * 0.5::DOUBLE), count(*) - 1)::INT] AS p50, list_sort(list(value))[1 + least(floor(count(*) * 0.99::DOUBLE), count(*) - 1)::INT] AS p99 FROM events""")
def ops_metrics(spark, sf_dir):
    return O.summary(_log(spark, sf_dir), "ts", "value", "failed")


@query("SELECT event_id, ts, CASE WHEN event_type = 'error' THEN '[FAILED] ' ELSE '' END || event_type AS description, value AS seconds FROM events WHERE value >= 90 ORDER BY ts DESC, event_id DESC LIMIT 100")
def ops_slow(spark, sf_dir):
    return O.slow(_log(spark, sf_dir), "ts", "value", "failed", "event_type", 90.0, "event_id")


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS place, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC), 9) AS part FROM customer")
def idx_rank(spark, sf_dir):
    by = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc())
    return read(spark, sf_dir, "customer").select("c_custkey", F.rank().over(by).cast("bigint").alias("place"), F.round(F.percent_rank().over(by), 9).alias("part"))


@query("SELECT day, user_id, total, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, user_id) AS place FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, round(sum(value), 4) AS total FROM events GROUP BY ALL)) WHERE place <= 3")
def idx_leaderboard(spark, sf_dir):
    daily = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.col("total").desc(), "user_id")).cast("bigint")
    return daily.withColumn("place", place).where("place <= 3")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def idx_bitmap(spark, sf_dir):
    bits = read(spark, sf_dir, "events").groupBy("event_type", F.expr("bitmap_bucket_number(user_id)").alias("bucket")).agg(F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(user_id)))").alias("n"))
    return bits.groupBy("event_type").agg(F.sum("n").alias("users"))


# -- streams, presets, bounds


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream: what is there now, in one run."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, CASE WHEN value >= 50 THEN '[FAILED] ' ELSE '' END || event_type AS event_type FROM events WHERE value >= 40")
def stream_slow(spark, sf_dir):
    marked = _event_stream(spark, sf_dir).withColumn("failed", F.col("value") >= 50)
    found = ST.slow(marked, 40, "value", "event_type", "failed").select("event_id", "event_type")
    return ST.run_to_files(found)


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H') AS start, count(*) AS operations FROM events GROUP BY 1")
def stream_rates(spark, sf_dir):
    rates = ST.rates(_event_stream(spark, sf_dir), window="1 hour", slide="1 hour")
    return ST.run_to_memory(rates.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "operations"), f"rates_{uuid.uuid4().hex}", "complete")


@query("SELECT s[floor(len(s) * 0.025)::BIGINT + 1] AS low_c_acctbal, s[len(s) - floor(len(s) * 0.025)::BIGINT] AS high_c_acctbal FROM (SELECT list_sort(list(c_acctbal)) AS s FROM customer)")
def robust_bounds(spark, sf_dir):
    return WS.robust_bounds(read(spark, sf_dir, "customer"), ["c_acctbal"])


@query("SELECT 'n_nationkey' AS path, 'number' AS type UNION ALL SELECT 'n_regionkey', 'number'")
def profile_pick(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    return WS.pick_fields(P.profile(nation.select(R.variant_row(nation).alias("v")), "v"), "KEY").select("path", "type")


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def source_tables(spark, sf_dir):
    return spark.createDataFrame([(e.name,) for e in WS.load_entities(spark, sf_dir)], "name string")
