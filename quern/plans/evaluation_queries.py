"""Queries of selection and evaluation over the driver's tables; replies of models are derived from row ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import evaluation as E
from quern.operators import history, selection
from quern.plans.retrieval_queries import _CELL, _GRAMS, _TOPK, ADMISSION, _candidates, _excerpt_sql, vector_topk
from quern.session import read_table

FIELDS = ["topic", "content", "papers", "time", "fee", "year"]
LABELS = {"fee": "học phí", "papers": "hồ sơ", "time": "thời gian"}
LIMIT = 5
SCOPE = "Tuyển sinh các trường"
MISSING = "no information"


def _admissions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "admissions")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return history.once(read_table(spark, sf, "messages"))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return history.once(read_table(spark, sf, "audit_logs"))


_FIELD_REPLY = """CASE row_id % 5 WHEN 0 THEN '["fee", "time", "fee"]' WHEN 1 THEN '["fee", "other"]' WHEN 2 THEN 'the fee' WHEN 3 THEN '[]' ELSE '["year"]' END"""


def field_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Fields for each topic as a question: those it names, those a reply selects."""
    text = F.lower(F.coalesce(F.col("`Chủ đề`"), F.lit("")))
    explicit = F.array_compact(F.array(*[F.when(T.has_phrase(text, phrase), F.lit(k)) for k, phrase in LABELS.items()]))
    rows = _admissions(spark, sf).select("row_id", selection.selected_fields(explicit, F.expr(_FIELD_REPLY), FIELDS).alias("f"))
    return rows.select("row_id", F.array_join("f", ",").alias("fields"))


_RECORD_REPLY = """CASE query_id // 20 % 4 WHEN 0 THEN '[2, "0", 2]' WHEN 1 THEN '[]' WHEN 2 THEN '[1, 99]' ELSE '[4, 3]' END"""


def record_selection(spark: SparkSession, sf: str) -> DataFrame:
    found = vector_topk(spark, sf).select("query_id", "rank", "vec_id")
    replies = found.select("query_id").distinct().select("query_id", F.expr(_RECORD_REPLY.replace("//", "div")).alias("reply"))
    return selection.selected_records(found, replies)


def selector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first five topics of each school as candidates."""
    rows = E.newest_first(_admissions(spark, sf).filter("`Trường` is not null").withColumn("older", -F.col("row_id")), ["Trường"], ["older"], LIMIT)
    got = selection.selector_rows(rows.drop("no"), "Trường", "row_id", "Chủ đề", ADMISSION)
    return got.select("row_id", F.col("index").cast("bigint").alias("index"), "title", "excerpt")


def scoped_passage(spark: SparkSession, sf: str) -> DataFrame:
    return _admissions(spark, sf).select("row_id", selection.passage(SCOPE, ADMISSION, 300).alias("passage"))


def field_samples(spark: SparkSession, sf: str) -> DataFrame:
    got = selection.field_samples(_admissions(spark, sf).filter("`Trường` is not null"), "Trường", "row_id", ADMISSION)
    return got.select(F.col("`Trường`").alias("school"), *[F.array_join(label, "|").alias(label) for _, label in ADMISSION])


def discovery_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = _audit(spark, sf).filter("user_query is not null")
    got = rows.select("id", F.posexplode(selection.discovery_queries(T.strip(F.col("user_query")), F.col("user_query"), F.split("user_query", r"[?.] ?"))).alias("pos", "query"))
    return got.select("id", F.col("pos").cast("bigint").alias("pos"), "query")


def pinned_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that are spelled like one of the school's active ones, those of every tenth row."""
    rows = _admissions(spark, sf).filter("`Trường` is not null")
    active = rows.filter("row_id % 10 = 0").select("Trường", F.col("`Chủ đề`").alias("title"))
    return selection.pinned(rows, active, ["Trường"], "Chủ đề").select("row_id")


def contextual_queries(spark: SparkSession, sf: str) -> DataFrame:
    titles = F.array_compact(F.array("`Chủ đề`", "`Trường`"))
    return _admissions(spark, sf).select("row_id", selection.contextual_query(titles, F.coalesce("`Nội dung`", F.lit("")), F.expr("row_id % 3 = 0")).alias("query"))


def specific_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Schools to which the most specific phrase of a content points, by the topics of all schools."""
    rows = _admissions(spark, sf)
    grams = lambda c: T.ngrams(T.tokens(F.lower(F.col(f"`{c}`"))))
    return selection.specific_owners(rows.select(F.col("row_id").alias("question_id"), grams("Nội dung").alias("phrases")), rows.select(F.col("`Trường`").alias("owner"), grams("Chủ đề").alias("phrases")))


_ROUTE_REPLY = """CASE row_id % 5 WHEN 0 THEN '{"route": "hoc_vu"}' WHEN 1 THEN '{"route": "else"}' WHEN 2 THEN '{"route": "none", "x": 1}' WHEN 3 THEN 'hoc_vu' ELSE '{"route": "none"}' END"""


def route_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _admissions(spark, sf).select("row_id", selection.route_of(F.expr(_ROUTE_REPLY), ["hoc_vu", "none"]).alias("route"))


def closed_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies as lists that lack their last bracket, on odd rows another one."""
    body = F.expr("CASE row_id % 3 WHEN 0 THEN '[' || body WHEN 1 THEN '[' || body || ']' ELSE '[[' || body END")
    rows = history.once(read_table(spark, sf, "raw_records"), "row_id")
    return rows.select("row_id", (F.length(selection.closed_list(body)) - F.length(body)).cast("bigint").alias("added"))


_PLAN = """CASE row_id % 4 WHEN 0 THEN '[{"record": 0, "fields": ["fee", "time", "fee"]}]' WHEN 1 THEN '[{"record": 1, "fields": []}]' WHEN 2 THEN '[{"record": 0, "fields": ["x"]}]' ELSE '[{"record": 0, "fields": []}]' END"""


def answer_plans(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.create_map(F.lit("title"), F.coalesce("`Chủ đề`", F.lit("")), F.lit("fee"), F.coalesce("`Phí hoặc học bổng`", F.lit("")), F.lit("time"), F.coalesce("`Thời gian`", F.lit("")))
    return _admissions(spark, sf).select("row_id", selection.answer_plan(F.expr(_PLAN), F.array(doc), ["fee", "time"], MISSING).alias("answer"))


def public_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = history.once(read_table(spark, sf, "raw_records"), "row_id")
    got = selection.public_fields(F.col("body"), ["Học phí", "Hồ sơ", "Thời gian"])
    return rows.select("row_id", *[F.try_element_at(got, F.lit(n)).alias(a) for a, n in (("fee", "Học phí"), ("papers", "Hồ sơ"), ("time", "Thời gian"))])


def host_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts of each school's sources; on odd numbers of them the list also holds a path."""
    hosts = _admissions(spark, sf).filter("`Trường` is not null").groupBy("`Trường`").agg(F.array_sort(F.collect_set(F.regexp_extract("`Nguồn`", "^https?://([^/]+)", 1))).alias("h"))
    listed = F.when(F.length("Trường") % 3 == 0, F.concat("h", F.array(F.lit("a.example/x")))).otherwise(F.transform("h", lambda x: F.concat(F.upper(x), F.lit("."))))
    return hosts.select(F.col("Trường").alias("school"), F.array_join(selection.sound_hosts(listed), ",").alias("hosts"))


# -- evaluation ------------------------------------------------------------------------------------


def _cached(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf)
    results = rows.filter("event_type = 'view'").select("user_id", "value", F.concat_ws("-", "user_id", F.to_date("ts")).alias("request_id"))
    events = rows.filter("event_type = 'click'").select(
        F.concat_ws("-", "user_id", F.to_date("ts")).alias("request_id"), F.struct("ts", "event_id").alias("seq"), (F.col("value") > 12).alias("cache_hit"), (F.col("value") > 6).alias("cache_enabled")
    )
    return E.with_cache(results, events)


def cache_counts(spark: SparkSession, sf: str) -> DataFrame:
    return E.cache_counts(_cached(spark, sf), ["request_id"])


def uncached_results(spark: SparkSession, sf: str) -> DataFrame:
    return E.uncached(_cached(spark, sf)).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_KIND = "CASE event_type WHEN 'click' THEN 'cache' WHEN 'view' THEN 'complete' WHEN 'search' THEN CASE WHEN value > 20 THEN 'selection' ELSE 'other' END ELSE 'other' END"


def full_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("user_id", F.to_date("ts").alias("day"), F.expr(_KIND).alias("kind"), F.expr("CASE WHEN value < 30 THEN 'full' ELSE 'selected' END").alias("mode"))
    return E.full_context(rows, ["user_id", "day"])


def transcript(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.date_trunc("hour", "created_at").alias("hour")
    turns = _audit(spark, sf).select("conversation_id", hour, F.col("created_at").alias("at"), "id")
    messages = _messages(spark, sf).select("conversation_id", hour, F.col("created_at").alias("at"), "id")
    return E.transcript(turns, messages, ["conversation_id", "hour"]).select(F.col("place").cast("bigint").alias("place"), "source", "id")


def loose_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of no audited hour of their conversation: an anti join on two keys."""
    return transcript(spark, sf).filter("source = 'message'").select("id")


def capture_check(spark: SparkSession, sf: str) -> DataFrame:
    jobs = history.once(read_table(spark, sf, "ingestion_jobs"))
    got = E.capture_check(jobs, F.col("status"), "profile", ["id", "domain", "generation"])
    return got.select(F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("statuses"), "malformed", "missing", "verdict")


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("requires"))


def runnable_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("requires"))
    got = E.runnable(rows, F.array(F.lit("click"), F.lit("view")))
    return got.select("user_id", "day", F.array_join("missing", ",").alias("missing"), "runs")


def required_domains(spark: SparkSession, sf: str) -> DataFrame:
    return E.required_domains(_scenarios(spark, sf).filter("user_id % 2 = 0"))


def manifest_results(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users whose scenario the manifest has: the even ones."""
    manifest = _scenarios(spark, sf).filter("user_id % 2 = 0").select(F.col("user_id").alias("scenario"), F.size("requires").alias("requires"))
    return E.with_manifest(_events(spark, sf).select(F.col("user_id").alias("scenario"), "event_id"), manifest)


def variant_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _audit(spark, sf).select("used_online_search", "rag_score", E.says_absent(F.col("llm_final_response")).alias("absent"))
    got = E.variant_summary(rows, "used_online_search", "rag_score", "absent")
    return got.select("used_online_search", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "flagged")


def distinct_options(spark: SparkSession, sf: str) -> DataFrame:
    return E.distinct_options(_audit(spark, sf), ["used_online_search", "failure_type"])


def vector_check(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors rounded to three places, against themselves."""
    rows = read_table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("actual"), F.col("embedding").cast("array<double>").alias("expected"))
    return E.vector_check(rows, ["label"]).select("label", "n", F.round("max_error", 9).alias("max_error"), F.round("min_cosine", 9).alias("min_cosine"), "usable", "small_difference")


def even_ids(spark: SparkSession, sf: str) -> DataFrame:
    """32 evenly spread vectors of the sorted ids: a sampling operator."""
    return E.even_ids(read_table(spark, sf, "embeddings").select("vec_id"), "vec_id").select("vec_id")


def order_changes(spark: SparkSession, sf: str) -> DataFrame:
    found = vector_topk(spark, sf).filter("rank <= 5").select("query_id", "vec_id", "score", F.round("score", 1).alias("coarse"))
    return E.order_changes(found, "query_id", "vec_id", "coarse", "score")


def placements(spark: SparkSession, sf: str) -> DataFrame:
    return E.placements(_events(spark, sf), F.expr("CASE WHEN event_id % 7 > 0 THEN event_type END"))


def fastest_batch(spark: SparkSession, sf: str) -> DataFrame:
    got = E.fastest(_events(spark, sf).select((F.col("event_id") % 6).alias("batch"), "value"), "batch", "value")
    return got.select("batch", F.round("median", 6).alias("median"))


def prompt_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).select("id", E.prompt_size(F.array("user_query", "retrieved_local_context")).cast("bigint").alias("size"))


def paired_spans(spark: SparkSession, sf: str) -> DataFrame:
    got = E.paired_spans(_events(spark, sf), ["user_id"], ["ts", "event_id"], "ts", F.col("event_type") == "click", F.col("event_type") == "purchase")
    return got.select("event_id", "elapsed_ms")


def lock_times(spark: SparkSession, sf: str) -> DataFrame:
    task = F.concat("event_type", F.expr("CASE event_id % 3 WHEN 0 THEN '.wait' WHEN 1 THEN '.held' ELSE '' END"))
    got = E.lock_times(_events(spark, sf).withColumn("task", task), "task", "value")
    return got.select("lock", "waits", F.round("waited", 4).alias("waited"), "holds", F.round("held", 4).alias("held"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).groupBy(E.outcome(F.col("failure_type"), ["MCP_PROMPT"], ["ONLINE_SEARCH_EXECUTED"]).alias("outcome")).agg(F.count("*").alias("n"))


def activity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select(
        "event_id", F.col("event_type").alias("task"), F.expr("CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE 'note' END").alias("event"),
        F.expr("CASE event_id % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'control_flow' END").alias("status"), F.expr("CASE WHEN event_id % 22 = 0 THEN 'Timeout' END").alias("error"),
        F.when(F.col("event_id") % 3 > 0, F.col("value") * 1000).alias("elapsed_ms"),
    )
    return E.activity(rows, {"click": "Chat", "view": "Retrieval"}, ["Chat"]).select("event_id", F.regexp_replace("message", r" \([0-9.,]+ s\)$", " (t)").alias("message"))


def source_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _admissions(spark, sf)
    targets = rows.filter("`Trường` is not null").select("Trường").distinct().withColumn("target", F.lit("Học bổng")).unionByName(spark.createDataFrame([("không có trường", "Học phí")], "`Trường` string, target string"))
    got = E.source_audit(rows, targets, "Trường", "row_id", "Chủ đề")
    return got.select(F.col("`Trường`").alias("school"), "scanned", "matches", F.array_join("first_matches", ",").alias("first_matches"), "status")


def nearest_titles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _admissions(spark, sf).filter("`Trường` is not null")
    targets = rows.select("Trường").distinct().withColumn("target", F.lit("Hoc bong toan phan"))
    return E.nearest_titles(rows, targets, "Trường", "Chủ đề").select(F.col("`Trường`").alias("school"), "no", "title", F.round("ratio", 6).alias("ratio"))


def unit_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _audit(spark, sf).select("id", E.per_unit(F.col("llm_final_response")).alias("words"))


def conversation_list(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations of each user that exists, newest first."""
    users = read_table(spark, sf, "users").select(F.col("id").alias("user_id"))
    conv = history.latest_state(read_table(spark, sf, "conversations"), "id", ["updated_at"], ["user_id", "updated_at"]).join(users, "user_id")
    return E.newest_first(conv, ["user_id"], ["updated_at", "id"]).select("user_id", "no", "id")


def history_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).filter("conversation_id is not null").select("conversation_id", "created_at", "id")
    return E.oldest_first(rows, ["conversation_id"], ["created_at", "id"]).select("conversation_id", F.col("no").cast("bigint").alias("no"), "id")


def newest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 newest jobs: a top-k report."""
    jobs = history.once(read_table(spark, sf, "ingestion_jobs")).withColumn("at", F.expr("try_cast(created_at as timestamp)"))
    return jobs.orderBy(F.desc("at"), F.desc("id")).limit(20).select("id", "domain", "status")


def candidate_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with the title of their record, also those whose record is gone."""
    titles = read_table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.substring("text", 1, 40).alias("title"))
    return _candidates(spark, sf).join(titles, "record_id", "left").select("query_id", "vec_id", "score", "title")


QUERIES = {
    f.__name__: f
    for f in (
        field_selection, record_selection, selector_rows, scoped_passage, field_samples, discovery_queries, pinned_filter, contextual_queries, specific_owners, route_decisions, closed_lists, answer_plans, public_bodies,
        host_lists, cache_counts, uncached_results, full_context, transcript, loose_messages, capture_check, runnable_scenarios, required_domains, manifest_results, variant_summary, distinct_options, vector_check, even_ids,
        order_changes, placements, fastest_batch, prompt_sizes, paired_spans, lock_times, outcomes, activity, source_audit, nearest_titles, unit_rates, conversation_list, history_listing, newest_jobs, candidate_titles,
    )
}

_M = "m AS (SELECT DISTINCT ON (id) * FROM messages)"
_A = "a AS (SELECT DISTINCT ON (id) * FROM audit_logs)"
_PHRASE = r"(^|[^\p{{L}}\p{{N}}_]){0}($|[^\p{{L}}\p{{N}}_])"
_LIST = "['" + "', '".join(FIELDS) + "']"
_PLAIN = r"""trim(regexp_replace(replace(strip_accents(lower({0})), 'đ', 'd'), '[\s\p{{Z}}]+', ' ', 'g'))"""
_COMPACT = r"""regexp_replace(replace(strip_accents(lower({0})), 'đ', 'd'), '[^\p{{L}}\p{{N}}]+', '', 'g')"""
_CACHE = """r AS (SELECT user_id, value, user_id || '-' || ts::DATE AS request_id FROM events WHERE event_type = 'view'),
c AS (SELECT user_id || '-' || ts::DATE AS request_id, value > 12 AS hit, value > 6 AS enabled FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY ts DESC, event_id DESC) = 1),
j AS (SELECT r.*, c.request_id IS NOT NULL AS cached, coalesce(hit, false) AS hit, enabled FROM r LEFT JOIN c USING (request_id))"""
_HOUR = "date_trunc('hour', created_at)"
_TRANSCRIPT = f"""{_M}, {_A}, l AS (SELECT id, created_at FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conversation_id = m.conversation_id AND date_trunc('hour', a.created_at) = date_trunc('hour', m.created_at))),
u AS (SELECT 'turn' AS source, created_at AS t, id FROM a UNION ALL SELECT 'message', created_at, id FROM l)"""

ORACLES = {
    "field_selection": "WITH q AS (SELECT row_id, lower(coalesce(\"Chủ đề\", '')) AS t, " + _FIELD_REPLY + " AS reply FROM admissions), e AS (SELECT row_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{_PHRASE.format(p)}') THEN '{k}' END" for k, p in LABELS.items()) + f"""], lambda x: x IS NOT NULL) AS ex,
    CASE WHEN json_valid(reply) THEN from_json(reply, '["VARCHAR"]') END AS sel FROM q),
    p AS (SELECT row_id, CASE WHEN sel IS NULL OR NOT list_has_all({_LIST}, sel) OR len(list_concat(ex, sel)) = 0 THEN {_LIST} ELSE list_concat(ex, sel) END AS f FROM e),
    o AS (SELECT row_id, f, unnest(list_distinct(f)) AS k FROM p), n AS (SELECT row_id, string_agg(k, ',' ORDER BY list_position(f, k)) AS s, bool_or(k = 'content') AS has FROM o GROUP BY row_id)
    SELECT row_id, CASE WHEN has THEN s ELSE s || ',content' END AS fields FROM n""",
    "record_selection": f"""WITH {_TOPK}, q AS (SELECT DISTINCT query_id, {_RECORD_REPLY} AS reply, {{0}} FROM topk),
    i AS (SELECT query_id, list_transform(from_json(reply, '["VARCHAR"]'), lambda x: x::INT) AS ix FROM q), n AS (SELECT query_id, max(rank) AS n FROM topk GROUP BY 1),
    v AS (SELECT query_id, ix, len(list_filter(ix, lambda x: x >= n)) = 0 AS valid FROM i JOIN n USING (query_id)),
    d AS (SELECT query_id, ix0, min(p) AS p FROM (SELECT query_id, unnest(ix) AS ix0, unnest(range(len(ix))) AS p FROM v WHERE valid) GROUP BY 1, 2)
    SELECT d.query_id, true AS valid, (row_number() OVER (PARTITION BY d.query_id ORDER BY p) - 1)::INT AS pos, vec_id FROM d JOIN topk t ON t.query_id = d.query_id AND t.rank = ix0 + 1
    UNION ALL SELECT query_id, false, NULL, NULL FROM v WHERE NOT valid""".replace(", {0}", ""),
    "selector_rows": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY \"Trường\" ORDER BY row_id) - 1 AS ix FROM admissions WHERE \"Trường\" IS NOT NULL QUALIFY ix < 5), k AS (SELECT *, greatest(120, least(500, 2600 // count(*) OVER (PARTITION BY \"Trường\"))) AS budget FROM c), "
    + _excerpt_sql(300).removeprefix("WITH ").replace("300 //", "budget //").replace("FROM admissions", "FROM k").replace("SELECT row_id, concat_ws", "SELECT row_id, ix, budget, \"Chủ đề\" AS topic, concat_ws").split("SELECT row_id, CASE WHEN length(t)")[0]
    + "SELECT row_id, ix AS index, substr(coalesce(topic, ''), 1, 160) AS title, CASE WHEN length(t) <= budget THEN t ELSE substr(t, 1, budget - 1) || '…' END AS excerpt FROM p",
    "scoped_passage": f"SELECT row_id, 'Dataset scope: {SCOPE}' || chr(10) || passage AS passage FROM (" + _excerpt_sql(300) + ")",
    "field_samples": "WITH f AS (SELECT *, row_number() OVER (PARTITION BY \"Trường\" ORDER BY row_id) AS n FROM admissions WHERE \"Trường\" IS NOT NULL QUALIFY n <= 2) SELECT \"Trường\" AS school, "
    + ", ".join("coalesce(string_agg(substr(\"{0}\", 1, 180), '|' ORDER BY n) FILTER ({1} <> ''), '') AS {2}".format(c, _CELL.format(f'"{c}"'), label) for c, label in ADMISSION) + " FROM f GROUP BY 1",
    "discovery_queries": f"""WITH {_A}, q AS (SELECT id, list_concat([{_CELL.format('user_query')}], CASE WHEN regexp_full_match(user_query, '[\\x00-\\x7F]*') THEN [user_query] ELSE [] END, regexp_split_to_array(user_query, '[?.] ?')) AS l FROM a WHERE user_query IS NOT NULL),
    d AS (SELECT id, query, min(p) AS p FROM (SELECT id, unnest(l) AS query, unnest(range(len(l))) AS p FROM q) WHERE {_CELL.format('query')} <> '' GROUP BY 1, 2) SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS pos, query FROM d""",
    "pinned_filter": f"WITH p AS (SELECT row_id, \"Trường\" AS s, {_PLAIN.format(chr(34) + 'Chủ đề' + chr(34))} AS t FROM admissions WHERE \"Trường\" IS NOT NULL) SELECT row_id FROM p WHERE (s, t) IN (SELECT s, t FROM p WHERE row_id % 10 = 0 AND t <> '')",
    "contextual_queries": f"SELECT row_id, CASE WHEN row_id % 3 = 0 AND coalesce(\"Chủ đề\", \"Trường\") IS NOT NULL THEN concat_ws('; ', \"Chủ đề\", \"Trường\") || '. ' ELSE '' END || {_CELL.format(chr(34) + 'Nội dung' + chr(34))} AS query FROM admissions",
    "specific_owners": f"""WITH {_GRAMS.format(5)}, one AS (SELECT gram, min(owner) AS owner FROM g WHERE owner IS NOT NULL GROUP BY 1 HAVING count(DISTINCT owner) = 1),
    w2 AS (SELECT row_id, regexp_extract_all(lower("Nội dung"), '[\\p{{L}}\\p{{N}}_]+') AS t FROM admissions),
    q AS (SELECT DISTINCT row_id, array_to_string(t[i:i + n - 1], ' ') AS gram FROM w2, range(2, 5) a(n), range(1, 2000) b(i) WHERE i + n - 1 <= len(t)),
    k AS (SELECT row_id, gram, owner FROM q JOIN one USING (gram))
    SELECT DISTINCT row_id AS question_id, owner FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.row_id = a.row_id AND length(b.gram) > length(a.gram) AND contains(' ' || b.gram || ' ', ' ' || a.gram || ' '))""",
    "route_decisions": f"WITH r AS (SELECT row_id, {_ROUTE_REPLY} AS t FROM admissions) SELECT row_id, CASE WHEN json_valid(t) AND json_keys(t) = ['route'] AND json_extract_string(t, '$.route') IN ('hoc_vu', 'none') THEN json_extract_string(t, '$.route') END AS route FROM r",
    "closed_lists": "WITH r AS (SELECT DISTINCT ON (row_id) row_id, CASE row_id % 3 WHEN 0 THEN '[' || body WHEN 1 THEN '[' || body || ']' ELSE '[[' || body END AS t FROM raw_records) SELECT row_id, CASE WHEN json_valid(t) THEN 0::BIGINT WHEN ends_with(t, '}') AND json_valid(t || ']') AND starts_with(t, '[{') THEN 1::BIGINT END AS added FROM r",
    "answer_plans": "WITH d AS (SELECT row_id, \"Chủ đề\" AS topic, trim(coalesce(\"Phí hoặc học bổng\", '')) AS fee, trim(coalesce(\"Thời gian\", '')) AS t FROM admissions) SELECT row_id, CASE row_id % 4 WHEN 0 THEN coalesce(topic, '') || ':' || chr(10) || '- fee: ' || CASE WHEN lower(fee) IN ('', 'nan', 'không có thông tin') THEN '" + MISSING + "' ELSE fee END || chr(10) || '- time: ' || CASE WHEN lower(t) IN ('', 'nan', 'không có thông tin') THEN '" + MISSING + "' ELSE t END WHEN 3 THEN coalesce(topic, '') || ':' || chr(10) || '" + MISSING + ".' END AS answer FROM d",
    "public_bodies": "WITH r AS (SELECT DISTINCT ON (row_id) * FROM raw_records), b AS (SELECT row_id, CASE WHEN json_valid(body) THEN body END AS j FROM r) SELECT row_id, j ->> '$.\"Học phí\"' AS fee, j ->> '$.\"Hồ sơ\"' AS papers, j ->> '$.\"Thời gian\"' AS time FROM b",
    "host_lists": r"""WITH h AS (SELECT "Trường" AS s, list_sort(list(DISTINCT regexp_extract("Nguồn", '^https?://([^/]+)', 1)) FILTER ("Nguồn" IS NOT NULL)) AS h FROM admissions WHERE "Trường" IS NOT NULL GROUP BY 1)
    SELECT s AS school, CASE WHEN length(s) % 3 <> 0 AND len(list_filter(h, lambda x: NOT regexp_full_match(lower(x), '(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,63}'))) = 0 THEN array_to_string(list_transform(h, lambda x: lower(x)), ',') END AS hosts FROM h""",
    "cache_counts": f"WITH {_CACHE}, g AS (SELECT request_id, count(*) FILTER (cached) AS cache_events, count(*) FILTER (hit) AS cache_hits, count(*) FILTER (NOT enabled) AS acknowledged FROM j GROUP BY 1) SELECT *, cache_events > 0 AND cache_hits = 0 AND acknowledged = cache_events AS cacheless FROM g",
    "uncached_results": f"WITH {_CACHE} SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM j WHERE NOT hit GROUP BY 1",
    "full_context": f"WITH k AS (SELECT user_id, ts::DATE AS day, {_KIND} AS kind, value < 30 AS f FROM events) SELECT user_id, day, coalesce(bool_and(f) FILTER (kind = 'cache'), false) AND coalesce(bool_and(f) FILTER (kind = 'complete'), false) AND count(*) FILTER (kind = 'selection') = 0 AS verified FROM k GROUP BY 1, 2",
    "transcript": f"WITH {_TRANSCRIPT} SELECT row_number() OVER (ORDER BY t NULLS FIRST, source, id) AS place, source, id FROM u",
    "loose_messages": f"WITH {_TRANSCRIPT} SELECT id FROM l",
    "capture_check": """WITH j AS (SELECT DISTINCT ON (id) * FROM ingestion_jobs), b AS (SELECT coalesce(status, '?') AS s, profile IS NULL OR NOT json_valid(profile) AS bad, coalesce(id, '') = '' OR coalesce(domain, '') = '' OR coalesce(generation, '') = '' AS lacks FROM j),
    c AS (SELECT s, count(*) AS n FROM b GROUP BY 1), t AS (SELECT count(*) FILTER (bad) AS malformed, count(*) FILTER (lacks) AS missing FROM b)
    SELECT (SELECT string_agg(s || '=' || n, ',' ORDER BY s, n) FROM c) AS statuses, malformed, missing, CASE WHEN malformed = 0 AND missing = 0 THEN 'pass' ELSE 'needs_review' END AS verdict FROM t""",
    "runnable_scenarios": "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events) SELECT user_id, day, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (event_type NOT IN ('click', 'view')), '') AS missing, bool_and(event_type IN ('click', 'view')) AS runs FROM d GROUP BY 1, 2",
    "required_domains": "SELECT DISTINCT event_type AS domain FROM events WHERE user_id % 2 = 0",
    "manifest_results": "WITH k AS (SELECT user_id AS scenario, count(DISTINCT event_type)::INT AS requires FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT scenario, event_id, requires FROM events JOIN k ON user_id = scenario",
    "variant_summary": rf"""WITH {_A}, p AS (SELECT used_online_search, rag_score, coalesce(regexp_matches({_PLAIN.format('llm_final_response')}, '{E.ABSENT.replace(chr(92) + "n", "")}'), false) AS f FROM a)
    SELECT used_online_search, count(*) AS n, round(avg(rag_score), 6) AS mean, round(quantile_cont(rag_score, 0.5), 6) AS median, count(*) FILTER (f) AS flagged FROM p GROUP BY 1""",
    "distinct_options": f"WITH {_A} SELECT used_online_search, failure_type, count(*) AS runs FROM a GROUP BY 1, 2",
    "vector_check": """WITH v AS (SELECT label, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS a, embedding::DOUBLE[] AS e FROM embeddings),
    c AS (SELECT label, list_max(list_transform(list_zip(a, e), lambda p: abs(p[1] - p[2]))) AS err, list_dot_product(a, e) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(e, e))) AS cos FROM v),
    g AS (SELECT label, count(*) AS n, max(err) AS m, min(cos) AS c FROM c GROUP BY 1) SELECT label, n, round(m, 9) AS max_error, round(c, 9) AS min_cosine, m <= 0.05 AND c >= 0.99 AS usable, c < 0.99999 OR m > 0.001 AS small_difference FROM g""",
    "even_ids": "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings) SELECT vec_id FROM r WHERE pos IN (SELECT (i * (n - 1)) // 31 FROM range(32) t(i))",
    "order_changes": f"""WITH {_TOPK}, f AS (SELECT query_id, vec_id, score, round(score, 1) AS coarse FROM topk WHERE rank <= 5)
    SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY coarse DESC, vec_id) <> string_agg(vec_id::VARCHAR, ',' ORDER BY score DESC, vec_id) AS changed FROM f GROUP BY 1""",
    "placements": "SELECT event_type AS provider, count(*) AS n FROM events WHERE event_id % 7 > 0 GROUP BY 1",
    "fastest_batch": "WITH g AS (SELECT event_id % 6 AS batch, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) SELECT batch, round(m, 6) AS median FROM g ORDER BY m, batch LIMIT 1",
    "prompt_sizes": f"WITH {_A} SELECT id, coalesce(length(user_query), 0) + coalesce(length(retrieved_local_context), 0) AS size FROM a",
    "paired_spans": """WITH w AS (SELECT event_id, event_type, ts, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM events)
    SELECT event_id, date_diff('microsecond', s, ts) / 1000 AS elapsed_ms FROM w WHERE event_type = 'purchase'""",
    "lock_times": "SELECT event_type AS lock, count(*) FILTER (event_id % 3 = 0) AS waits, round(sum(value) FILTER (event_id % 3 = 0), 4) AS waited, count(*) FILTER (event_id % 3 = 1) AS holds, round(sum(value) FILTER (event_id % 3 = 1), 4) AS held FROM events WHERE event_id % 3 < 2 GROUP BY 1",
    "outcomes": f"WITH {_A} SELECT CASE WHEN coalesce(failure_type, '') = '' THEN 'ok' WHEN failure_type = 'ONLINE_SEARCH_EXECUTED' THEN 'control_flow' WHEN failure_type = 'MCP_PROMPT' THEN 'cancelled' ELSE 'error' END AS outcome, count(*) AS n FROM a GROUP BY 1",
    "activity": """WITH e AS (SELECT event_id, event_type AS task, CASE event_type WHEN 'click' THEN 'Chat' WHEN 'view' THEN 'Retrieval' END AS label, event_id % 3 AS k, event_id % 11 AS s FROM events)
    SELECT event_id, CASE WHEN s = 0 THEN coalesce(label, task) || ': ERROR ' || CASE WHEN event_id % 22 = 0 THEN 'Timeout' ELSE '' END
    ELSE label || CASE WHEN k = 0 THEN ' working...' WHEN s = 1 THEN ' cancelled' ELSE ' finished' END || CASE WHEN k > 0 THEN ' (t)' ELSE '' END END AS message
    FROM e WHERE s <> 2 AND (s = 0 OR (label IS NOT NULL AND (k = 1 OR (k = 0 AND label = 'Chat'))))""",
    "source_audit": f"""WITH r AS (SELECT "Trường" AS s, row_id, contains({_COMPACT.format("coalesce(" + chr(34) + "Chủ đề" + chr(34) + ", '')")}, {_COMPACT.format("'Học bổng'")}) AS hit FROM admissions WHERE "Trường" IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY s, hit ORDER BY row_id) AS n FROM r)
    SELECT s AS school, count(*) AS scanned, count(*) FILTER (hit) AS matches, coalesce(string_agg(row_id::VARCHAR, ',' ORDER BY row_id) FILTER (hit AND n <= 5), '') AS first_matches, CASE WHEN bool_or(hit) THEN 'title_matches_found' ELSE 'no_title_match' END AS status FROM k GROUP BY 1
    UNION ALL SELECT 'không có trường', 0, 0, '', 'unavailable'""",
    "conversation_list": "WITH c AS (SELECT id, max_by(user_id, updated_at) AS user_id, max(updated_at) AS u FROM conversations GROUP BY id) SELECT c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY u DESC, c.id DESC) AS no, c.id FROM c JOIN users ON users.id = c.user_id",
    "history_listing": f"WITH {_M} SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at NULLS FIRST, id) AS no, id FROM m WHERE conversation_id IS NOT NULL",
    "newest_jobs": "WITH j AS (SELECT DISTINCT ON (id) * FROM ingestion_jobs) SELECT id, domain, status FROM j ORDER BY created_at::TIMESTAMPTZ DESC NULLS LAST, id DESC LIMIT 20",
    "candidate_titles": f"WITH {_TOPK} SELECT query_id, vec_id, score, substr(text, 1, 40) AS title FROM cand LEFT JOIN documents ON doc_id = record_id",
}
