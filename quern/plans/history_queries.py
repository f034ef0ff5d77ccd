"""History, administration, telemetry and evaluation queries over messages, audit logs, jobs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import sources_col, tag_value
from quern.operators import history, telemetry
from quern.session import read_table
from quern.streaming import views

STAGES = ["click", "purchase", "view", "search"]
# Outcomes that the failed-queries view asks for.
FAILED = ("LOW_CONFIDENCE", "MCP_PROMPT", "ONLINE_SEARCH_EXECUTED")
DOMAIN = "hoc_vu"
_SOURCES = (
    "CASE WHEN id % 23 = 0 THEN 'RAG_ROUTE:none' END", "CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'RAG_DOMAIN:hoc_vu' ELSE 'RAG_DOMAIN:tuyen_sinh' END END",
    "CASE WHEN id % 3 > 0 THEN 'RAG_CONTENT:x' END", "CASE WHEN id % 4 > 0 THEN concat('Title ', cast(id % 11 as varchar(9))) END", "' '", "CASE WHEN id % 4 = 3 THEN concat('Title ', cast(id % 3 as varchar(9))) END",
)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return history.once(read_table(spark, sf, "messages"))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return history.once(read_table(spark, sf, "audit_logs"))


def kpi_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = _messages(spark, sf).agg(F.count("*").alias("messages"), F.count_if(history.simple_role(F.col("role")) == "user").alias("user_messages"))
    c = read_table(spark, sf, "conversations").agg(F.count_distinct("id").alias("conversations"))
    a = _audit(spark, sf).agg(F.count_if("used_online_search").alias("online_searches"))
    return m.join(F.broadcast(c)).join(F.broadcast(a))  # one row each


def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).groupBy(F.coalesce(history.simple_role(F.col("role")), F.lit("?")).alias("role_name")).agg(F.count("*").alias("n"))


def daily_traffic(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).filter("created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def feedback_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).agg(F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == 0).alias("negative"))


def feedback_fanout(spark: SparkSession, sf: str) -> DataFrame:
    rated = _messages(spark, sf).filter("rating is not null").select("id", "rating")
    return history.feedback_routes(rated).select("sink", "id", history.rating_label(F.col("rating")).alias("label"))


def recent_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The 100 newest audit rows: a top-k report."""
    return _audit(spark, sf).orderBy(F.desc("created_at"), F.desc("id")).limit(100).select("id", "conversation_id", "created_at")


def failed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 newest failures: a top-k report."""
    rows = _audit(spark, sf).filter(F.col("failure_type").isin(*FAILED))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "failure_type", "user_query")


def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.upper(F.coalesce(F.nullif(F.trim("failure_type"), F.lit("")), F.lit("NONE")))
    return _audit(spark, sf).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg("rag_score"), 6).alias("mean_score"))


def preceding_user_message(spark: SparkSession, sf: str) -> DataFrame:
    return history.preceding_user_message(_messages(spark, sf), F.col("rating").isNotNull())


def history_tail(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_tail(_messages(spark, sf)).select("conversation_id", "turn", "id")


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Messages whose sources, derived from their ids, have every kind of tag and titles."""
    src = F.array_compact(F.array(*[F.expr(x) for x in _SOURCES]))
    return _messages(spark, sf).withColumn("sources", F.to_json(src))


def domain_segment(spark: SparkSession, sf: str) -> DataFrame:
    return history.domain_segment(_tagged(spark, sf), F.lit(DOMAIN), DOMAIN).select("conversation_id", "id")


def message_domains(spark: SparkSession, sf: str) -> DataFrame:
    src = sources_col(F.col("sources"))
    domain, score = tag_value(src, "RAG_DOMAIN:"), tag_value(src, "RAG_SCORE:")
    rows = _messages(spark, sf).select(domain.alias("domain"), score.cast("double").alias("score")).filter("domain is not null")
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.max("score"), 4).alias("best"))


def active_titles(spark: SparkSession, sf: str) -> DataFrame:
    got = history.active_titles(_tagged(spark, sf), F.lit(DOMAIN), DOMAIN, F.expr("CASE WHEN conversation_id % 2 = 0 THEN 'Title of ' || conversation_id END"))
    return got.select("conversation_id", "message_id", F.array_join("titles", "|").alias("titles"))


def user_conversations(spark: SparkSession, sf: str) -> DataFrame:
    users = read_table(spark, sf, "users").select(F.col("id").alias("uid"), F.col("user_id").alias("user_name"))
    conv = history.latest_state(read_table(spark, sf, "conversations").withColumn("own", F.struct("user_id", "created_at")), "id", ["updated_at"], ["user_id", "updated_at"])
    counts = conv.groupBy("user_id").agg(F.count("*").alias("conversations"), F.max("updated_at").alias("last_update"))
    return users.join(counts, users.uid == counts.user_id).select("uid", "user_name", "conversations", "last_update")


def new_users(spark: SparkSession, sf: str) -> DataFrame:
    users = read_table(spark, sf, "users")
    asked = read_table(spark, sf, "conversations").select(F.col("user_id").alias("id")).filter("id is not null")
    return history.append_missing(users.filter("created_at < timestamp_ntz'2021-01-01'"), asked, "id")


def latest_conversation_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations").withColumn("locked", F.coalesce(F.get_json_object("checklist", "$._domain_state.locked") == "true", F.lit(False)))
    return history.latest_state(rows, "id", ["updated_at"], ["updated_at", "locked"])


def request_roles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).filter("conversation_id is not null").withColumn("r", history.simple_role(F.col("role")))
    return rows.groupBy("conversation_id").pivot("r", ["user", "assistant"]).agg(F.count(F.lit(1))).na.fill(0, ["user", "assistant"]).withColumnRenamed("user", "user_n").withColumnRenamed("assistant", "assistant_n")


def paired_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return request_roles(spark, sf).agg(F.count_if((F.col("user_n") > 0) & (F.col("assistant_n") > 0)).alias("paired"), F.count_if((F.col("user_n") > 0) & (F.col("assistant_n") == 0)).alias("unanswered"))


def conversations_without_audit(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").select("id").distinct().join(_audit(spark, sf).select(F.col("conversation_id").alias("id")), "id", "left_anti")


def audited_messages(spark: SparkSession, sf: str) -> DataFrame:
    keys = _audit(spark, sf).select("conversation_id").filter("conversation_id is not null").distinct()
    return _messages(spark, sf).join(keys, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.count("*").alias("n"))


def latest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    jobs = read_table(spark, sf, "ingestion_jobs").dropDuplicates(["id"]).withColumn("at", F.expr("try_cast(created_at as timestamp)"))
    return history.latest_state(jobs, "domain", ["at", "id"], ["id", "status"])


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def trailing_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry.trailing_context(_events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.select("event_id", F.array_join("context", ",").alias("context"))


def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    got = telemetry.latency(_events(spark, sf), ["event_type"], "value")
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


def stage_latency(spark: SparkSession, sf: str) -> DataFrame:
    got = telemetry.stage_latency(_events(spark, sf), "event_type", "value", STAGES)
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


def warm_latency(spark: SparkSession, sf: str) -> DataFrame:
    warm = telemetry.after_warm_up(_events(spark, sf).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    return warm.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def first_last_event(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.first_and_last(_events(spark, sf), ["user_id"], ["ts", "event_id"], ["event_id", "event_type"])


def _checks(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("value") > 40, "FAIL").when(F.col("value") > 25, "REVIEW").otherwise("PASS")
    return _events(spark, sf).select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "ts", status.alias("status"))


def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.roll_up(_checks(spark, sf), ["user_id", "day"]).groupBy("status").agg(F.count("*").alias("n"))


def best_alternative(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.best_alternative(_checks(spark, sf), ["user_id"], "event_type")


def broken_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry.broken_context(_checks(spark, sf), ["user_id"], "event_id", F.col("status") == "FAIL")
    return rows.groupBy("user_id").agg(F.count_if("after_failure").alias("after_failure"), F.count("*").alias("n"))


def paired_ab(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"))
    got = telemetry.paired_difference(rows, ["user_id"], "event_type", "mean", "click", "view")
    return got.select("user_id", *[F.round(c, 6).alias(c) for c in ("on_value", "off_value", "difference")])


def baseline_compare(spark: SparkSession, sf: str) -> DataFrame:
    mean = F.avg("value").alias("mean")
    late, early = (_events(spark, sf).filter(f).groupBy("event_type").agg(mean) for f in ("ts >= timestamp_ntz'2024-01-15'", "ts < timestamp_ntz'2024-01-15'"))
    got = telemetry.against_baseline(late, early, "event_type", 1.0)
    return got.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "base", "ratio", "change_percent")], "review")


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.over_rate(_events(spark, sf), "user_id", "ts", 2, "1 hour")


def set_checks(spark: SparkSession, sf: str) -> DataFrame:
    found = _events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("found"))
    lists = found.withColumn("required", F.array(F.lit("click"), F.lit("view"))).withColumn("forbidden", F.array(F.lit("error")))
    return telemetry.set_checks(lists, "required", "found", "forbidden").groupBy("user_id").agg(*[F.count_if(c).alias(c) for c in ("has_required", "exact", "none_forbidden")])


def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each uploaded file put together again in order, by pages of 100 lines."""
    rows = read_table(spark, sf, "raw_records").dropDuplicates(["row_id"]).withColumn("page", F.expr("cast(line_no as bigint) div 100"))
    return telemetry.join_chunks(rows.withColumn("at", F.struct("line_no", "row_id")), ["job_id", "page"], "at", "body")


def newest_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry.newest(_events(spark, sf).filter("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 3)
    return rows.select("user_id", "back", "event_id")


def user_totals(spark: SparkSession, sf: str) -> DataFrame:
    value = F.get_json_object("props", "$.k").cast("bigint")
    return _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(value).alias("k_sum"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


QUERIES = {
    f.__name__: f
    for f in (
        kpi_counts, role_counts, daily_traffic, feedback_counts, feedback_fanout, recent_audit, failed_queries, failure_counts, preceding_user_message, history_tail, domain_segment, message_domains, active_titles,
        user_conversations, new_users, latest_conversation_state, request_roles, paired_conversations, conversations_without_audit, audited_messages, latest_jobs, trailing_context, latency_stats, stage_latency,
        warm_latency, first_last_event, status_rollup, best_alternative, broken_context, paired_ab, baseline_compare, rate_limit, set_checks, stream_chunks, newest_errors, user_totals,
    )
}

_M = "m AS (SELECT DISTINCT ON (id) *, lower(trim(role)) AS r FROM messages)"
_A = "a AS (SELECT DISTINCT ON (id) * FROM audit_logs)"
_DOM = r"""nullif(regexp_extract(sources, 'RAG_DOMAIN:([^"''\\]+)', 1), '')"""
_TAGS = _M + ", s AS (SELECT id, conversation_id, created_at, r, list_filter([" + ", ".join(_SOURCES) + f"""], lambda x: x IS NOT NULL) AS src FROM m WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL),
d AS (SELECT *, list_filter(src, lambda x: starts_with(x, 'RAG_DOMAIN:'))[1][12:] AS tagged, list_contains(src, 'RAG_CONTENT:x') AS used FROM s),
t AS (SELECT *, r = 'assistant' AND (list_contains(src, 'RAG_ROUTE:none') OR coalesce(coalesce(tagged, CASE WHEN used THEN '{DOMAIN}' END) <> '{DOMAIN}', false)) AS said, r = 'assistant' AND used AND NOT said AS tells FROM d)"""
_P = "count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95"
_CHECKS = "c AS (SELECT user_id, ts::DATE AS day, event_type, event_id, CASE WHEN value > 40 THEN 2 WHEN value > 25 THEN 1 ELSE 0 END AS s FROM events)"
_NAME = "['PASS', 'REVIEW', 'FAIL'][{0} + 1]"

ORACLES = {
    "kpi_counts": f"WITH {_M}, {_A} SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM m WHERE r = 'user') AS user_messages, (SELECT count(DISTINCT id) FROM conversations) AS conversations, (SELECT count(*) FROM a WHERE used_online_search) AS online_searches",
    "role_counts": f"WITH {_M} SELECT coalesce(r, '?') AS role_name, count(*) AS n FROM m GROUP BY 1",
    "daily_traffic": f"WITH {_M} SELECT created_at::DATE AS day, count(*) AS n FROM m WHERE created_at IS NOT NULL GROUP BY 1",
    "feedback_counts": f"WITH {_M} SELECT count(*) FILTER (rating = 1) AS positive, count(*) FILTER (rating = 0) AS negative FROM m",
    "feedback_fanout": f"""WITH {_M}, f AS (SELECT 'all' AS sink, id, rating FROM m WHERE rating IS NOT NULL UNION ALL SELECT 'positive', id, rating FROM m WHERE rating = 1 UNION ALL SELECT 'negative', id, rating FROM m WHERE rating = 0)
    SELECT sink, id, CASE WHEN rating = 1 THEN 'positive' ELSE 'negative' END AS label FROM f""",
    "recent_audit": f"WITH {_A} SELECT id, conversation_id, created_at FROM a ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 100",
    "failed_queries": f"WITH {_A} SELECT id, failure_type, user_query FROM a WHERE failure_type IN {FAILED} ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50",
    "failure_counts": f"WITH {_A} SELECT upper(coalesce(nullif(trim(failure_type), ''), 'NONE')) AS outcome, count(*) AS n, round(avg(rag_score), 6) AS mean_score FROM a GROUP BY 1",
    "preceding_user_message": f"""WITH {_M}, w AS (SELECT *, last_value(CASE WHEN r = 'user' THEN id END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u
    FROM m WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL) SELECT conversation_id, id AS message_id, u AS user_message_id FROM w WHERE rating IS NOT NULL AND r = 'assistant'""",
    "history_tail": f"""WITH {_M}, t AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, id DESC) AS back FROM m WHERE conversation_id IS NOT NULL QUALIFY back <= 8)
    SELECT conversation_id, (row_number() OVER (PARTITION BY conversation_id ORDER BY back DESC))::INT AS turn, id FROM t WHERE r IN ('user', 'assistant')""",
    "domain_segment": f"""WITH {_TAGS}, e AS (SELECT conversation_id, max({{'c': created_at, 'i': id}}) AS x FROM t WHERE said GROUP BY 1)
    SELECT conversation_id, id FROM t LEFT JOIN e USING (conversation_id) WHERE x IS NULL OR {{'c': created_at, 'i': id}} > x""",
    "message_domains": rf"""WITH {_M}, d AS (SELECT {_DOM} AS domain, nullif(regexp_extract(sources, 'RAG_SCORE:([0-9.]+)', 1), '')::DOUBLE AS score FROM m) SELECT domain, count(*) AS n, round(max(score), 4) AS best FROM d WHERE domain IS NOT NULL GROUP BY 1""",
    "active_titles": f"""WITH {_TAGS}, n AS (SELECT *, list_filter(src, lambda x: trim(x) <> '' AND NOT starts_with(x, 'RAG_')) AS names FROM t),
    g AS (SELECT conversation_id, max({{'c': created_at, 'i': id}}) FILTER (said) AS closed, max({{'c': created_at, 'i': id}}) FILTER (tells AND len(names) > 0) AS told FROM n GROUP BY 1),
    o AS (SELECT conversation_id, told.i AS id FROM g WHERE told IS NOT NULL AND (closed IS NULL OR told > closed)),
    w AS (SELECT o.conversation_id, o.id, CASE WHEN len(names) = 2 AND names[1] = names[2] THEN names[1] ELSE array_to_string(names, '|') END AS titles FROM o JOIN n ON n.id = o.id)
    SELECT g.conversation_id, w.id AS message_id, coalesce(titles, CASE WHEN closed IS NULL AND g.conversation_id % 2 = 0 THEN 'Title of ' || g.conversation_id END, '') AS titles FROM g LEFT JOIN w USING (conversation_id)""",
    "user_conversations": """WITH c AS (SELECT id, max_by(user_id, updated_at) AS user_id, max(updated_at) AS updated_at FROM conversations GROUP BY id),
    n AS (SELECT user_id, count(*) AS conversations, max(updated_at) AS last_update FROM c GROUP BY 1) SELECT u.id AS uid, u.user_id AS user_name, conversations, last_update FROM users u JOIN n ON n.user_id = u.id""",
    "new_users": "SELECT DISTINCT user_id AS id FROM conversations WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT id FROM users WHERE created_at < TIMESTAMP '2021-01-01')",
    "latest_conversation_state": "SELECT id, max(updated_at) AS updated_at, max_by(coalesce(json_extract_string(checklist, '$._domain_state.locked') = 'true', false), updated_at) AS locked FROM conversations GROUP BY id",
    "request_roles": f"WITH {_M} SELECT conversation_id, count(*) FILTER (r = 'user') AS user_n, count(*) FILTER (r = 'assistant') AS assistant_n FROM m WHERE conversation_id IS NOT NULL GROUP BY 1",
    "paired_conversations": f"WITH {_M}, g AS (SELECT conversation_id, count(*) FILTER (r = 'user') AS u, count(*) FILTER (r = 'assistant') AS s FROM m WHERE conversation_id IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (u > 0 AND s > 0) AS paired, count(*) FILTER (u > 0 AND s = 0) AS unanswered FROM g",
    "conversations_without_audit": "SELECT DISTINCT id FROM conversations WHERE id NOT IN (SELECT conversation_id FROM audit_logs WHERE conversation_id IS NOT NULL)",
    "audited_messages": f"WITH {_M} SELECT conversation_id, count(*) AS n FROM m WHERE conversation_id IN (SELECT conversation_id FROM audit_logs) GROUP BY 1",
    "latest_jobs": "WITH j AS (SELECT DISTINCT ON (id) * FROM ingestion_jobs) SELECT domain, id, status FROM j QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at::TIMESTAMPTZ DESC, id DESC) = 1",
    "trailing_context": "SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), ',') AS context FROM events",
    "latency_stats": f"SELECT event_type, {_P} FROM events GROUP BY 1",
    "stage_latency": f"WITH s AS (SELECT unnest({STAGES}) AS event_type) SELECT s.event_type, {_P} FROM s LEFT JOIN events USING (event_type) GROUP BY 1",
    "warm_latency": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM r WHERE k > 1 GROUP BY 1",
    "first_last_event": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events)
    SELECT user_id, max(event_id) FILTER (k = 1) AS first_event_id, max(event_type) FILTER (k = 1) AS first_event_type, max(event_id) FILTER (z = 1) AS last_event_id, max(event_type) FILTER (z = 1) AS last_event_type FROM r GROUP BY 1""",
    "status_rollup": f"WITH {_CHECKS}, w AS (SELECT max(s) AS s FROM c GROUP BY user_id, day) SELECT {_NAME.format('s')} AS status, count(*) AS n FROM w GROUP BY 1",
    "best_alternative": f"WITH {_CHECKS}, w AS (SELECT user_id, event_type, max(s) AS s FROM c GROUP BY ALL) SELECT user_id, event_type, {_NAME.format('s')} AS status FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s, event_type) = 1",
    "broken_context": f"WITH {_CHECKS}, w AS (SELECT user_id, event_id, min(CASE WHEN s = 2 THEN event_id END) OVER (PARTITION BY user_id) AS f FROM c) SELECT user_id, count(*) FILTER (event_id > f) AS after_failure, count(*) AS n FROM w GROUP BY 1",
    "paired_ab": "WITH g AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1) SELECT user_id, round(a, 6) AS on_value, round(b, 6) AS off_value, round(a - b, 6) AS difference FROM g",
    "baseline_compare": """WITH g AS (SELECT event_type, avg(value) FILTER (ts >= TIMESTAMP '2024-01-15') AS m, avg(value) FILTER (ts < TIMESTAMP '2024-01-15') AS b FROM events GROUP BY 1)
    SELECT event_type, round(m, 6) AS mean, round(b, 6) AS base, round(m / b, 6) AS ratio, round((m / b - 1) * 100, 6) AS change_percent, m / b > 1.0 AS review FROM g""",
    "rate_limit": "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2",
    "set_checks": """WITH g AS (SELECT user_id, ts::DATE AS day, list(DISTINCT event_type) AS f FROM events GROUP BY ALL)
    SELECT user_id, count(*) FILTER (list_has_all(f, ['click', 'view'])) AS has_required, count(*) FILTER (list_has_all(f, ['click', 'view']) AND len(f) = 2) AS exact, count(*) FILTER (NOT list_contains(f, 'error')) AS none_forbidden FROM g GROUP BY 1""",
    "stream_chunks": "WITH r AS (SELECT DISTINCT ON (row_id) * FROM raw_records) SELECT job_id, (line_no // 100)::BIGINT AS page, string_agg(body, '' ORDER BY line_no, row_id) AS content FROM r GROUP BY 1, 2",
    "newest_errors": "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS back, event_id FROM events WHERE event_type = 'error' QUALIFY back <= 3",
    "user_totals": "SELECT user_id, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k_sum, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1",
}


def stream_daily_traffic(spark: SparkSession, sf: str) -> DataFrame:
    """Daily event counts computed by a stream over the table's files."""
    table = read_table(spark, sf, "events")
    return views.run_complete(views.daily_counts(views.file_stream(spark, sf, "events.parquet", table.schema), "ts"))


QUERIES["stream_daily_traffic"] = stream_daily_traffic
ORACLES["stream_daily_traffic"] = "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1"
