"""Queries on search, vectors, chat, structure, metrics, batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import documents, metrics, search, summaries
from foliant.plans.registry import n, on, q, r6, register, s_long, s_r6, table

# --- search -------------------------------------------------------------------------------------------------

QUERY = "the tion en"
KEYWORD = " + ".join(f"CASE WHEN contains(lower(text), {q(w)}) THEN 10 ELSE 0 END" for w in QUERY.split(" "))
EXACT = "that and"


@on("documents", "search_keyword", f"SELECT doc_id, {s_long('score')} AS score FROM (SELECT doc_id, {KEYWORD} AS score FROM documents) WHERE score > 0")
def search_keyword(docs: DataFrame) -> DataFrame:
    return search.search(docs, QUERY).select("doc_id", n(F.col("score")).alias("score"))


def s_snippet(query: str) -> str:
    at = f"(instr(lower(text), {q(query)}) - 1)"
    end = f"least(length(text), {at} + {len(query) + 100})"
    return (
        f"CASE WHEN {at} < 0 THEN left(text, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END ELSE "
        f"CASE WHEN {at} > 100 THEN '...' ELSE '' END || substr(text, greatest(0, {at} - 100) + 1, {end} - greatest(0, {at} - 100)) "
        f"|| CASE WHEN {end} < length(text) THEN '...' ELSE '' END END"
    )


@on(
    "documents",
    "search_exact",
    f"SELECT doc_id, CAST(100 AS BIGINT) AS score, {s_snippet(EXACT)} AS snippet FROM documents WHERE contains(lower(text), {q(EXACT)})",
)
def search_exact(docs: DataFrame) -> DataFrame:
    return search.search(docs, EXACT, "exact").select("doc_id", n(F.col("score")).alias("score"), "snippet")


@on("documents", "search_snippet", f"SELECT doc_id, {s_snippet(EXACT)} AS snippet FROM documents")
def search_snippet(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", search.snippet(F.col("text"), EXACT).alias("snippet"))


def s_nearest(score: str, order: str, where: str = "") -> str:
    return f"""
    WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour, {score} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, neighbour) AS rank FROM p {where})
    SELECT query_id, neighbour, {s_r6('score')} AS score, rank FROM r WHERE rank <= 5
    """


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
L2 = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def _nearest(vectors: DataFrame, **options) -> DataFrame:
    """Queries are the rows whose id is divisible by 50, against all rows."""
    found = search.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, **options)
    return found.select("query_id", "neighbour", r6(F.col("score")).alias("score"), n(F.col("rank")).alias("rank"))


@on("embeddings", "knn_cosine", s_nearest(COSINE, "DESC"))
def knn_cosine(vectors: DataFrame) -> DataFrame:
    return _nearest(vectors)


@on("embeddings", "knn_threshold", s_nearest(COSINE, "DESC", "WHERE score >= .3"))
def knn_threshold(vectors: DataFrame) -> DataFrame:
    return _nearest(vectors, least=0.3)


@on("embeddings", "knn_l2", s_nearest(L2, ""))
def knn_l2(vectors: DataFrame) -> DataFrame:
    return _nearest(vectors, measure="l2")


@on(
    "conversations",
    "chat_intent",
    "SELECT role, intent, count(*) AS n FROM (SELECT role, CASE WHEN contains(lower(text), 'résumé') THEN 'summary' WHEN contains(lower(text), 'mots') THEN 'words' ELSE 'canned' END AS intent FROM conversations) GROUP BY role, intent",
)
def chat_intent(turns: DataFrame) -> DataFrame:
    return turns.select("role", search.chat_intent(F.col("text")).alias("intent")).groupBy("role", "intent").agg(F.count("*").alias("n"))


@on(
    "conversations",
    "chat_statistics",
    "SELECT conv_id, count(*) AS questions, count(*) FILTER (WHERE role = 'user') AS user_turns, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id",
)
def chat_statistics(turns: DataFrame) -> DataFrame:
    """Turns of each conversation; both sides count as questions, as the served counter has it."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("questions"), F.count_if(F.col("role") == "user").alias("user_turns"), n(F.max("turn")).alias("last_turn"))


@on(
    "conversations",
    "prompts",
    """
    SELECT conv_id AS query_id, 'Contexte:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: '
           || min_by(text, turn) || chr(10) || chr(10) || 'Réponse:' AS prompt
    FROM conversations GROUP BY conv_id
    """,
)
def prompts(turns: DataFrame) -> DataFrame:
    """A prompt for each conversation: its turns as context, its first turn as the question."""
    first = F.min_by("text", "turn")
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"), first.alias("question"))
    context = F.array_join(F.col("c.text"), "\n\n")
    return rows.select(F.col("conv_id").alias("query_id"), F.format_string(search.PROMPT, context, F.col("question")).alias("prompt"))


# --- summaries ------------------------------------------------------------------------------------------------


@on("documents", "textrank")
def textrank(docs: DataFrame) -> DataFrame:
    found = summaries.textrank(docs.select("doc_id", "text"))
    return found.select("doc_id", "summary", summaries.compression(F.col("summary"), F.col("text")).alias("compression_ratio"))


@register(
    "table_markdown",
    """
    WITH r AS (SELECT n_regionkey, string_agg('| ' || n_name || ' | ' || CAST(n_nationkey AS VARCHAR) || ' |' || chr(10), '' ORDER BY n_nationkey) AS body FROM nation GROUP BY n_regionkey)
    SELECT n_regionkey, '[TABLE]' || chr(10) || '| name | key |' || chr(10) || '| --- | --- |' || chr(10) || body || '[/TABLE]' || chr(10) AS text FROM r
    """,
)
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked table of the nations of each region."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    head = F.array(F.array(F.lit("name"), F.lit("key")))
    cells = F.concat(head, F.transform("r", lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string"))))
    return rows.select("n_regionkey", documents.table_text(cells).alias("text"))


# --- metrics --------------------------------------------------------------------------------------------------


def points(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("name"), "value", "ts", F.col("event_id").alias("point_id"))


POINTS = "(SELECT event_type AS name, value, ts, event_id AS point_id FROM events)"
STATS = f"""count(*) AS count, {s_r6('min(value)')} AS min, {s_r6('max(value)')} AS max, {s_r6('avg(value)')} AS mean, {s_r6('median(value)')} AS median,
    {s_r6('stddev_pop(value)')} AS std, {s_r6('quantile_cont(value, .95)')} AS p95, {s_r6('quantile_cont(value, .99)')} AS p99, {s_r6('max_by(value, (ts, point_id))')} AS last_value"""


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.select("name", "count", *[r6(F.col(c)).alias(c) for c in stats.columns if c not in ("name", "count")])


@on("events", "metric_summary", f"SELECT name, {STATS} FROM {POINTS} GROUP BY name")
def metric_summary(events: DataFrame) -> DataFrame:
    return _rounded(metrics.summary(points(events)))


@on("events", "metric_summary_trailing", f"SELECT name, {STATS} FROM {POINTS} WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY name")
def metric_summary_trailing(events: DataFrame) -> DataFrame:
    return _rounded(metrics.summary(metrics.trailing(points(events), 24 * 60)))


@on(
    "events",
    "metric_running_counter",
    f"SELECT name, point_id, {s_r6('sum(value) OVER (PARTITION BY name ORDER BY ts, point_id ROWS UNBOUNDED PRECEDING)')} AS total FROM {POINTS}",
)
def metric_running_counter(events: DataFrame) -> DataFrame:
    return metrics.running_counter(points(events), "ts", "point_id").select("name", "point_id", r6(F.col("total")).alias("total"))


@on(
    "events",
    "metric_last_1000",
    f"SELECT name, point_id, rank FROM (SELECT name, point_id, row_number() OVER (PARTITION BY name ORDER BY ts DESC, point_id DESC) AS rank FROM {POINTS}) WHERE rank <= 1000",
)
def metric_last_1000(events: DataFrame) -> DataFrame:
    found = metrics.last_points(points(events), 1000, F.col("ts").desc(), F.col("point_id").desc())
    return found.select("name", "point_id", n(F.col("rank")).alias("rank"))


#: Rules for the event types that stand in for metrics.
EVENT_RULES = {
    "click": (90.0, "warning", "Clicks: %s", "plain2"),
    "purchase": (95.0, "critical", "Purchases: %s", "plain2"),
    "view": (99.0, "warning", "Views: %s", "plain2"),
}
RULE_VALUES = ", ".join(f"({q(k)}, {t}, {q(level)}, {q(m.replace('%s', ''))})" for k, (t, level, m, _) in EVENT_RULES.items())


@on(
    "events",
    "alert_candidates",
    f"""
    WITH rules(name, threshold, level, message) AS (VALUES {RULE_VALUES})
    SELECT p.name, p.point_id, {s_r6('p.value')} AS value, level, message || format('{{:.2f}}', value) AS message FROM {POINTS} p JOIN rules r ON p.name = r.name AND value > threshold
    """,
)
def alert_candidates(events: DataFrame) -> DataFrame:
    found = metrics.breaches(points(events), metrics.rules_frame(events.sparkSession, EVENT_RULES))
    return found.select("name", "point_id", r6(F.col("value")).alias("value"), "level", "message")


#: Each breach's successor is the first one over an hour later; the kept ones are reached from a metric's first breach.
@on(
    "events",
    "alert_cooldown",
    f"""
    WITH RECURSIVE rules(name, threshold, level, message) AS (VALUES {RULE_VALUES}),
    b AS (SELECT p.name, level, ts, value, message || format('{{:.2f}}', value) AS message FROM {POINTS} p JOIN rules r ON p.name = r.name AND value > threshold),
    f AS (SELECT b.*, c.ts AS next FROM b ASOF LEFT JOIN b AS c ON b.name = c.name AND b.level = c.level AND b.ts + INTERVAL 1 HOUR < c.ts),
    k AS (SELECT * FROM f WHERE (name, level, ts) IN (SELECT (name, level, min(ts)) FROM b GROUP BY name, level)
          UNION ALL SELECT f.* FROM k JOIN f ON f.name = k.name AND f.level = k.level AND f.ts = k.next)
    SELECT name, level, ts, value, message FROM k
    """,
)
def alert_cooldown(events: DataFrame) -> DataFrame:
    found = metrics.breaches(points(events), metrics.rules_frame(events.sparkSession, EVENT_RULES))
    return metrics.cooled_down(found.select("name", "level", "ts", "value", "message"), 3600)


RESOLVED = "value < 60"


@on(
    "events",
    "health",
    """
    WITH l AS (SELECT CASE WHEN value > 95 THEN 'critical' WHEN value > 80 THEN 'warning' ELSE 'info' END AS level FROM events)
    SELECT CASE WHEN count(*) FILTER (WHERE level = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (WHERE level = 'warning') > 0 THEN 'warning' ELSE 'healthy' END AS system_health FROM l
    """,
)
def health(events: DataFrame) -> DataFrame:
    level = F.when(F.col("value") > 95, "critical").when(F.col("value") > 80, "warning").otherwise("info")
    return metrics.health(events.select(level.alias("level")))


@on(
    "events",
    "recent_alerts",
    f"SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) WHERE NOT ({RESOLVED})",
)
def recent_alerts(events: DataFrame) -> DataFrame:
    """Of the latest twenty alerts the unresolved ones."""
    latest = events.withColumn("resolved", F.expr(RESOLVED)).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20)
    return latest.where(~F.col("resolved")).select("event_id", "event_type")


@on(
    "events",
    "dashboard",
    f"""
    WITH h AS (SELECT CASE WHEN bool_or(value > 95) THEN 'critical' ELSE 'warning' END AS system_health FROM (SELECT value FROM events WHERE value > 90 ORDER BY ts DESC LIMIT 20))
    SELECT s.*, system_health FROM (SELECT name, {STATS} FROM {POINTS} WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND name IN ('click', 'purchase', 'view') GROUP BY name) s, h
    """,
)
def dashboard(events: DataFrame) -> DataFrame:
    level = F.when(F.col("value") > 95, "critical").otherwise("warning")
    alerts = events.select("ts", level.alias("level"), F.lit(False).alias("resolved")).where("value > 90")
    found = metrics.dashboard(points(events), alerts, ["click", "purchase", "view"], 24 * 60)
    return found.select("name", "count", *[r6(F.col(c)).alias(c) for c in found.columns if c not in ("name", "count", "system_health")], "system_health")


@on(
    "events",
    "metrics_export",
    f"""
    SELECT name, strftime(ts, '%Y-%m-%d') AS day, '[' || string_agg('{{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","value":' || CAST(value AS VARCHAR) || '}}', ',' ORDER BY ts, value) || ']' AS points
    FROM {POINTS} GROUP BY 1, 2
    """,
)
def metrics_export(events: DataFrame) -> DataFrame:
    found = metrics.by_metric_json(points(events))
    return found.select("name", F.date_format("chunk", "yyyy-MM-dd").alias("day"), "points")


@on(
    "events",
    "processing_time_stats",
    f"""
    SELECT {s_r6('coalesce(sum(value) FILTER (WHERE value <> 0), 0)')} AS total_time, {s_r6('coalesce(avg(value) FILTER (WHERE value <> 0), 0)')} AS average_time,
           {s_r6('coalesce(min(value) FILTER (WHERE value <> 0), 0)')} AS min_time, {s_r6('coalesce(max(value) FILTER (WHERE value <> 0), 0)')} AS max_time
    FROM events
    """,
)
def processing_time_stats(events: DataFrame) -> DataFrame:
    found = documents.timing(events, "value")
    return found.select(*[r6(F.col(c)).alias(c) for c in found.columns])


@on(
    "documents",
    "group_by_source",
    "SELECT source, count(*) AS total, count(*) FILTER (WHERE lang = 'fr') AS processed FROM documents GROUP BY source",
)
def group_by_source(docs: DataFrame) -> DataFrame:
    return documents.group_by_type(docs.select("source", (F.col("lang") == "fr").alias("processed")), "source")


@on(
    "documents",
    "processing_statistics",
    f"""
    SELECT count(*) AS total_files, count(*) FILTER (WHERE lang = 'fr') AS processed_files, count(*) FILTER (WHERE lang <> 'fr') AS remaining_files,
           {s_r6("count(*) FILTER (WHERE lang = 'fr') * 100.0 / count(*)")} AS completion_rate
    FROM documents
    """,
)
def processing_statistics(docs: DataFrame) -> DataFrame:
    found = documents.processing_statistics(docs.select((F.col("lang") == "fr").alias("processed")))
    return found.withColumn("completion_rate", r6(F.col("completion_rate")))


@register(
    "filename_semi_anti",
    """
    SELECT 'known' AS side, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    UNION ALL SELECT 'new', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
    """,
)
def filename_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is stored already, and rows that are new."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda how, side: docs.join(held, "doc_id", how).agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return count("left_semi", "known").unionByName(count("left_anti", "new"))


@on("documents", "registry_health", "SELECT 'healthy' AS status, count(*) AS documents_count FROM documents")
def registry_health(docs: DataFrame) -> DataFrame:
    return docs.agg(F.first(F.lit("healthy")).alias("status"), F.count("*").alias("documents_count"))


@on(
    "documents",
    "language_mode",
    "SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, min(doc_id)) AS n FROM documents GROUP BY source, lang) WHERE n = 1",
)
def language_mode(docs: DataFrame) -> DataFrame:
    """The most frequent language of each source; of equally frequent ones that seen first."""
    counted = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return counted.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("lang"))


NAMES = "'report ' || CAST(doc_id AS VARCHAR) || '.' || ['PDF', 'docx', 'txt', 'exe'][doc_id % 4 + 1]"


@on(
    "documents",
    "file_routing",
    f"""
    SELECT doc_id, {NAMES} AS name, ['pdf', 'word', 'text', 'unknown'][doc_id % 4 + 1] AS reader, doc_id % 4 < 3 AS allowed FROM documents
    """,
)
def file_routing(docs: DataFrame) -> DataFrame:
    from foliant.sources.files import allowed_upload, reader_of

    endings = F.array(*map(F.lit, ("PDF", "docx", "txt", "exe")))
    name = F.concat(F.lit("report "), F.col("doc_id").cast("string"), F.lit("."), F.get(endings, (F.col("doc_id") % 4).cast("int")))
    docs = docs.select("doc_id", name.alias("name"))
    return docs.select("doc_id", "name", reader_of(F.col("name")).alias("reader"), allowed_upload(F.col("name")).alias("allowed"))


@on(
    "documents",
    "metadata_xml",
    "SELECT doc_id, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<document_metadata><doc_id>' || CAST(doc_id AS VARCHAR) || '</doc_id><language>' || lang || '</language><source>' || source || '</source></document_metadata>' AS xml FROM documents",
)
def metadata_xml(docs: DataFrame) -> DataFrame:
    from foliant.sources.sinks import to_xml

    return docs.select("doc_id", to_xml({"doc_id": F.col("doc_id"), "language": F.col("lang"), "source": F.col("source")}).alias("xml"))


# --- streams --------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, label: str) -> str:
    """A new folder on the storage that driver and executors share."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return f"{root.rstrip('/')}/foliant-streams/{label}-{uuid.uuid4().hex}"


@register(
    "stream_window_stats",
    f"""
    SELECT event_type AS name, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS count, {s_r6('min(value)')} AS min, {s_r6('max(value)')} AS max, {s_r6('avg(value)')} AS mean
    FROM events GROUP BY 1, 2
    """,
)
def stream_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of a stream over all that there is, as one run that processes it and stops."""
    from foliant.streaming.metrics import run_once, window_stats

    schema = table(spark, sf_dir, "events").schema
    # A glob, as a file source reads folders and patterns but no single file.
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    timed = points(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    found = window_stats(timed, "1 day")
    out = _scratch(spark, "windows")
    run_once(found, f"{out}/rows", f"{out}/checkpoint", "complete")
    rows = spark.read.schema(found.schema).parquet(f"{out}/rows")
    ntz = F.col("start").cast("timestamp_ntz")
    return rows.select("name", ntz.alias("start"), "count", *[r6(F.col(c)).alias(c) for c in ("min", "max", "mean")])


