"""Retrieval and ingestion queries: embeddings as vectors, two chunks per record; documents, admissions and services as records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import external, ingest, retrieval
from quern.session import read_table

K, CUTOFF, RECOVERY, LIMIT = 20, 0.3, 0.45, 5
HOSTS = ["rungthong.example", "tin.songtram.example"]
MISSING = "no information"
ADMISSION = [("Chủ đề", "topic"), ("Nội dung", "content"), ("Hồ sơ", "papers"), ("Thời gian", "time"), ("Phí hoặc học bổng", "fee"), ("Năm áp dụng", "year")]
SERVICE = {"service_code": "Mã dịch vụ", "service_name": "Tên dịch vụ", "station": "Trạm phục vụ", "rules": "Quy tắc và giới hạn", "fee": "Giá dịch vụ", "channels": "Kênh đăng ký"}
FORMS = ["học bổng", "học phí", "thủ tục", "xét tuyển", "đề án tuyển sinh"]


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings")
    queries = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.vector_topk(queries, vectors, K)


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return vector_topk(spark, sf).select("query_id", F.expr("vec_id div 2").alias("record_id"), "vec_id", "score")


def best_chunk_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.best_chunk_topk(_candidates(spark, sf), CUTOFF, LIMIT)


def candidate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Many chunks of a record among the candidates: ten records."""
    return retrieval.candidate_decisions(_candidates(spark, sf).withColumn("record_id", F.col("vec_id") % 10), CUTOFF, LIMIT)


def low_score_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates other than the query's own vector, so that some queries have none above the cut-off."""
    return retrieval.recover_low_scores(_candidates(spark, sf).filter("vec_id <> query_id"), RECOVERY, LIMIT).select("query_id", "vec_id", "score", "rank", "recovered")


def merge_query_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = vector_topk(spark, sf)
    groups = found.select((F.col("query_id") % 100).alias("request_id"), F.col("query_id").alias("group_no"), F.col("rank").alias("arrival"), F.expr("vec_id div 2").alias("record_id"), "score")
    return retrieval.merge_groups(groups, 10)


def sigmoid_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "events").select("event_id", (F.col("value") - 10).alias("logit"))
    return rows.select("event_id", F.round(T.sigmoid(F.col("logit")), 9).alias("relevance"))


def record_lookup(spark: SparkSession, sf: str) -> DataFrame:
    records = read_table(spark, sf, "embeddings").groupBy(F.expr("vec_id div 2").alias("record_id")).agg(F.min("label").alias("label"))
    return retrieval.lookup_records(_candidates(spark, sf), records).select("query_id", "vec_id", "record_id", "label")


def records_without_vector(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"))
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"))
    return retrieval.missing_records(docs, vectors)


def entry_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """One retrieval end to end: top-k, best chunk above the cut-off, record lookup."""
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), "lang", "source")
    best = best_chunk_topk(spark, sf)
    return best.join(docs, "record_id", "left").select("query_id", "rank", "record_id", "score", "lang", "source")


def _admissions(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "admissions")


def evidence_context(spark: SparkSession, sf: str) -> DataFrame:
    return _admissions(spark, sf).select("row_id", *retrieval.evidence(ADMISSION, MISSING))


def record_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return _admissions(spark, sf).select("row_id", retrieval.excerpt(ADMISSION, 300).alias("passage"))


def public_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "workshop_services")
    public = retrieval.public_columns([c for c in rows.columns if c != "row_id"], ["Mã kiểm tra nội bộ"])
    return rows.select("row_id", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"c{i}") for i, c in enumerate(public)])


def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = _admissions(spark, sf)
    text = retrieval.embedding_text("passage: ", F.col("`Chủ đề`"), [(label, F.col(f"`{c}`")) for c, label in ADMISSION[1:4]])
    return rows.filter("`Chủ đề` is not null").select("row_id", text.alias("text"))


def ingest_records(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, _ = ingest.prepare(_services(spark, sf), SERVICE, "service_name", "row_id")
    return rows.select(F.expr("split(record_id, ':')[1]").cast("bigint").alias("copy_no"), *SERVICE, F.get_json_object("raw_json", "$['Mã kiểm tra nội bộ']").alias("unmapped_value"))


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    _, report, _ = ingest.prepare(_services(spark, sf), SERVICE, "service_name", "row_id")
    return report.select("input_rows", "indexed_rows", "empty_rows", "missing_primary", F.size("unmapped_columns").cast("bigint").alias("unmapped"))


def _services(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "workshop_services")


def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    return ingest.content_ids(docs, ["text", "lang"], ["doc_id"]).select("doc_id", "record_id")


def multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    texts = read_table(spark, sf, "documents").select("text", "lang")
    return ingest.multiset_difference(texts, texts.distinct())


def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Eight evenly spread rows of the whole table: a sampling operator."""
    from quern.operators.ordered import fragment, rank_rows

    rows = _admissions(spark, sf).select("row_id", F.substring(F.coalesce(F.col("`Chủ đề`"), F.lit("")), 1, 400).alias("topic"))
    ranked = rank_rows(fragment(rows, [], ["row_id"]), [], ["row_id"], "at")
    return ranked.filter(F.col("at").isin(retrieval.even_positions(rows.count()))).select("row_id", "topic")


def url_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("`Nguồn`")
    return _admissions(spark, sf).select("row_id", external.url_host(url).alias("host"), external.allowed(url, HOSTS).alias("allowed"))


def external_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = _admissions(spark, sf).filter("`Trường` is not null").select(
        F.col("`Trường`").alias("request_id"), F.col("row_id").alias("position"), F.col("`Nguồn`").alias("url"), F.col("`Chủ đề`").alias("title"), F.col("`Nội dung`").alias("snippet")
    )
    return external.clean_results(rows, HOSTS, 5)


def grounded_support(spark: SparkSession, sf: str) -> DataFrame:
    claims = _admissions(spark, sf).groupBy(F.expr("row_id div 2").alias("claim_id")).agg(F.array_sort(F.collect_set("`Nguồn`")).alias("urls"))
    return external.grounded_support(claims.withColumn("cited", F.expr("if(size(urls) > 0, sequence(0, size(urls) - 1), array())")), HOSTS)


def form_match(spark: SparkSession, sf: str) -> DataFrame:
    forms = spark.createDataFrame(list(enumerate(FORMS)), "form_no bigint, form string")
    rows = _admissions(spark, sf).select("row_id", T.loose_words_col(F.col("`Chủ đề`")).alias("title"), T.loose_words_col(F.col("`Nội dung`")).alias("question"))
    return external.match_forms(rows, forms)


def loose_words(spark: SparkSession, sf: str) -> DataFrame:
    return _admissions(spark, sf).select("row_id", T.loose_words_col(F.col("`Nội dung`")).alias("words"))


def token_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    grams = _admissions(spark, sf).select(F.explode(T.ngrams(T.tokens(F.lower(F.col("`Chủ đề`"))), 2, 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def ngram_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of two to four words that belong to the topics of one school only."""
    rows = _admissions(spark, sf).select(F.col("`Trường`").alias("owner"), F.explode(T.ngrams(T.tokens(F.lower(F.col("`Chủ đề`"))))).alias("gram")).distinct()
    return rows.filter("owner is not null").groupBy("gram").agg(F.count("*").alias("owners"), F.min("owner").alias("owner")).filter("owners = 1").select("gram", "owner")


def phrase_fields(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lower(F.col("`Nội dung`"))
    return _admissions(spark, sf).select("row_id", *[F.coalesce(T.has_phrase(text, p), F.lit(False)).alias(f"p{i}") for i, p in enumerate(["học phí", "phí", "hồ sơ"])])


def scalar_forms(spark: SparkSession, sf: str) -> DataFrame:
    topic = F.coalesce(F.col("`Chủ đề`"), F.lit(""))
    return _admissions(spark, sf).select("row_id", T.short_title(topic).alias("title"), T.escape_html(F.coalesce(F.col("`Nội dung`"), F.lit(""))).alias("html"), T.is_ascii(topic).alias("ascii"))


def normalised_forms(spark: SparkSession, sf: str) -> DataFrame:
    topic = F.col("`Chủ đề`")
    cols = {"header_form": T.header_form_col, "plain_words": T.plain_words_col, "ascii_words": T.ascii_words_col, "graded_words": T.graded_words_col, "compact_letters": T.compact_letters_col}
    return _admissions(spark, sf).select("row_id", *[f(topic).alias(n) for n, f in cols.items()])


def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Topics that hold one of the wanted phrases, or as many words in a row that are at least 0.85 similar to it."""
    return retrieval.fuzzy_match(_admissions(spark, sf).select("row_id", F.col("`Chủ đề`").alias("text")), FORMS)


QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, best_chunk_topk, candidate_decisions, low_score_recovery, merge_query_groups, sigmoid_scores, record_lookup, records_without_vector, entry_retrieval, evidence_context, record_excerpt,
        public_projection, embedding_text, ingest_records, ingest_report, content_ids, multiset_difference, even_sample, url_allowlist, external_clean, grounded_support, form_match, loose_words, token_ngrams,
        ngram_owners, phrase_fields, scalar_forms, normalised_forms, fuzzy_match,
    )
}

_TOPK = f"""
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
topk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {K}),
cand AS (SELECT query_id, vec_id // 2 AS record_id, vec_id, score FROM topk),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, record_id ORDER BY score DESC, vec_id) AS chunk FROM cand WHERE score >= {CUTOFF}) WHERE chunk = 1),
bestk AS (SELECT query_id, record_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM best QUALIFY rank <= {LIMIT})
"""
_BLANKS = "('', 'nan', 'không có thông tin')"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_CELL = "coalesce(" + _STRIP + ", '')"
_SERVICE_COLUMNS = ("Mã dịch vụ", "Tên dịch vụ", "Trạm phục vụ", "Quy tắc và giới hạn", "Thời gian xử lý yêu cầu", "Giá dịch vụ", "Quầy hỗ trợ", "Kênh đăng ký", "Mã kiểm tra nội bộ")
_SERVICE_ROW = " || ".join(_CELL.format(f'"{c}"') for c in _SERVICE_COLUMNS)
_HOST = r"""nullif(CASE WHEN regexp_matches("Nguồn", '[\x00-\x20\x7f]') OR length("Nguồn") > 4096 THEN '' ELSE rtrim(lower(regexp_extract("Nguồn", '^(?i:https?)://([^/?#@:\\]+)(?::[0-9]{1,5})?(?:[/?#]|$)', 1)), '.') END, '')"""
_ALLOWED = "coalesce(" + " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in HOSTS) + ", false)"
_LOOSE = r"""trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '\s+', ' ', 'g'))"""
_GRAMS = r"""w AS (SELECT row_id, "Trường" AS owner, regexp_extract_all(lower("Chủ đề"), '[\p{{L}}\p{{N}}_]+') AS t FROM admissions),
g AS (SELECT owner, array_to_string(t[i:i + n - 1], ' ') AS gram FROM w, range(2, {0}) a(n), range(1, 200) b(i) WHERE i + n - 1 <= len(t))"""


_FOLDED = r"""trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"""
_WORDS = r"""trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}_{1}]+', ' ', 'g'))"""


def _excerpt_sql(longest: int) -> str:
    vals = {c: _CELL.format(f'"{c}"') for c, _ in ADMISSION}
    filled = " + ".join(f"({v} <> '')::INT" for v in vals.values())
    lines = ", ".join(f"CASE WHEN {vals[c]} <> '' THEN '{label}: ' || CASE WHEN length({vals[c]}) <= lim THEN {vals[c]} ELSE substr({vals[c]}, 1, lim) || '…' END END" for c, label in ADMISSION)
    return f"""WITH l AS (SELECT *, greatest(40, least(400, {longest} // greatest(1, least({filled}, 8)))) AS lim FROM admissions),
    p AS (SELECT row_id, concat_ws(chr(10), {lines}) AS t FROM l)
    SELECT row_id, CASE WHEN length(t) <= {longest} THEN t ELSE substr(t, 1, {longest - 1}) || '…' END AS passage FROM p"""


ORACLES = {
    "vector_topk": f"WITH {_TOPK} SELECT query_id, vec_id, score, rank::INT AS rank FROM topk",
    "best_chunk_topk": f"WITH {_TOPK} SELECT query_id, record_id, vec_id, score, rank::INT AS rank FROM bestk",
    "candidate_decisions": f"""WITH {_TOPK},
    ten AS (SELECT query_id, vec_id % 10 AS record_id, vec_id, score FROM cand),
    f AS (SELECT *, score >= {CUTOFF} AND row_number() OVER (PARTITION BY query_id, record_id ORDER BY score DESC, vec_id) = 1 AS fresh FROM ten),
    a AS (SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM f)
    SELECT query_id, record_id, vec_id, score, CASE WHEN score < {CUTOFF} THEN 'below_minimum_score' WHEN ahead >= {LIMIT} THEN 'result_limit_reached' WHEN NOT fresh THEN 'duplicate_record' ELSE 'kept' END AS reason FROM a""",
    "low_score_recovery": f"""WITH {_TOPK}, c AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cand WHERE vec_id <> query_id),
    m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM c WHERE rank <= {LIMIT})
    SELECT query_id, vec_id, score, rank::INT AS rank, top < {RECOVERY} AS recovered FROM m WHERE CASE WHEN top >= {RECOVERY} THEN score >= {RECOVERY} ELSE rank <= 3 END""",
    "merge_query_groups": f"""WITH {_TOPK}, g AS (SELECT query_id % 100 AS request_id, query_id AS group_no, rank::INT AS arrival, vec_id // 2 AS record_id, score FROM topk),
    b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY request_id, record_id ORDER BY score DESC, group_no, arrival) = 1)
    SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY score DESC, group_no, arrival, record_id))::INT AS rank FROM b QUALIFY rank <= 10""",
    "sigmoid_scores": "SELECT event_id, round(1 / (1 + exp(-(value - 10))), 9) AS relevance FROM events",
    "record_lookup": f"WITH {_TOPK}, r AS (SELECT vec_id // 2 AS record_id, min(label) AS label FROM embeddings GROUP BY 1) SELECT query_id, vec_id, record_id, label FROM cand JOIN r USING (record_id)",
    "records_without_vector": "SELECT DISTINCT doc_id AS record_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "entry_retrieval": f"WITH {_TOPK} SELECT query_id, rank::INT AS rank, record_id, score, lang, source FROM bestk LEFT JOIN documents ON doc_id = record_id",
    "evidence_context": "SELECT row_id, " + ", ".join(f"CASE WHEN lower({_CELL.format(chr(34) + c + chr(34))}) IN {_BLANKS} THEN '{MISSING}' ELSE \"{c}\" END AS {label}" for c, label in ADMISSION) + " FROM admissions",
    "record_excerpt": _excerpt_sql(300),
    "public_projection": "SELECT row_id, " + ", ".join(f"coalesce(\"{c}\", '') AS c{i}" for i, c in enumerate(_SERVICE_COLUMNS[:-1])) + " FROM workshop_services",
    "embedding_text": "SELECT row_id, concat_ws(chr(10), 'passage: ' || \"Chủ đề\", " + ", ".join(f"CASE WHEN {_CELL.format(chr(34) + c + chr(34))} <> '' THEN '{label}: ' || \"{c}\" END" for c, label in ADMISSION[1:4]) + ") AS text FROM admissions WHERE \"Chủ đề\" IS NOT NULL",
    "ingest_records": "SELECT row_number() OVER (PARTITION BY " + ", ".join(_CELL.format(f'"{c}"') for c in _SERVICE_COLUMNS) + " ORDER BY row_id) AS copy_no, " + ", ".join(f"{_CELL.format(chr(34) + c + chr(34))} AS {k}" for k, c in SERVICE.items()) + f", {_CELL.format(chr(34) + 'Mã kiểm tra nội bộ' + chr(34))} AS unmapped_value FROM workshop_services WHERE {_CELL.format(chr(34) + 'Tên dịch vụ' + chr(34))} <> ''",
    "ingest_report": f"""SELECT count(*) AS input_rows, count(*) FILTER ({_CELL.format(chr(34) + "Tên dịch vụ" + chr(34))} <> '') AS indexed_rows, count(*) FILTER ({_SERVICE_ROW} = '') AS empty_rows,
    count(*) FILTER ({_CELL.format(chr(34) + "Tên dịch vụ" + chr(34))} = '' AND {_SERVICE_ROW} <> '') AS missing_primary,
    (SELECT count(*) FROM (DESCRIBE workshop_services) WHERE column_name <> 'row_id' AND column_name NOT IN ({", ".join(f"'{c}'" for c in SERVICE.values())})) AS unmapped FROM workshop_services""",
    "content_ids": """WITH d AS (SELECT doc_id, sha256('lang' || chr(31) || coalesce(lang, '') || chr(30) || 'text' || chr(31) || coalesce(text, '') || chr(30)) AS h FROM documents)
    SELECT doc_id, h || ':' || row_number() OVER (PARTITION BY h ORDER BY doc_id) AS record_id FROM d""",
    "multiset_difference": "SELECT text, lang, 'left' AS side, count(*) - 1 AS extra FROM documents GROUP BY text, lang HAVING count(*) > 1",
    "even_sample": """WITH r AS (SELECT row_id, substr(coalesce("Chủ đề", ''), 1, 400) AS topic, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM admissions)
    SELECT row_id, topic FROM r WHERE pos IN (SELECT round_even(i * (n - 1) / 7.0, 0)::BIGINT FROM range(8) t(i), (SELECT count(*) AS n FROM admissions))""",
    "url_allowlist": f"WITH h AS (SELECT row_id, {_HOST} AS host FROM admissions) SELECT row_id, host, {_ALLOWED} AS allowed FROM h",
    "external_clean": f"""WITH h AS (SELECT *, {_HOST} AS host FROM admissions WHERE "Trường" IS NOT NULL),
    o AS (SELECT * FROM h WHERE {_ALLOWED} AND {_CELL.format(chr(34) + "Nội dung" + chr(34))} <> '' QUALIFY row_number() OVER (PARTITION BY "Trường", "Nguồn" ORDER BY row_id) = 1)
    SELECT "Trường" AS request_id, (row_number() OVER (PARTITION BY "Trường" ORDER BY row_id))::INT AS no, "Nguồn" AS url, substr(coalesce("Chủ đề", ''), 1, 300) AS title, substr({_CELL.format(chr(34) + "Nội dung" + chr(34))}, 1, 2500) AS snippet FROM o QUALIFY no <= 5""",
    "grounded_support": f"""WITH h AS (SELECT DISTINCT row_id // 2 AS claim_id, "Nguồn" AS url, {_HOST} AS host FROM admissions WHERE "Nguồn" IS NOT NULL),
    a AS (SELECT claim_id, url, {_ALLOWED} AS ok FROM h)
    SELECT claim_id, (row_number() OVER (PARTITION BY claim_id ORDER BY url))::INT AS source_no, url FROM a WHERE claim_id NOT IN (SELECT claim_id FROM a WHERE NOT ok)""",
    "form_match": "WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{f}')" for i, f in enumerate(FORMS)) + f""") t(form_no, form)),
    r AS (SELECT row_id, {_LOOSE.format('"Chủ đề"')} AS title, {_LOOSE.format('"Nội dung"')} AS question FROM admissions),
    m AS (SELECT row_id, form_no, CASE WHEN contains(title, form) THEN 0 ELSE 1 END AS src FROM r JOIN f ON contains(title, form) OR contains(question, form))
    SELECT row_id, form_no, CASE WHEN src = 0 THEN 'title' ELSE 'question' END AS matched_by FROM m QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY src, form_no) = 1""",
    "loose_words": f"SELECT row_id, {_LOOSE.format(chr(34) + 'Nội dung' + chr(34))} AS words FROM admissions",
    "token_ngrams": f"WITH {_GRAMS.format(4)} SELECT gram, count(*) AS n FROM g GROUP BY gram",
    "ngram_owners": f"WITH {_GRAMS.format(5)} SELECT gram, min(owner) AS owner FROM g WHERE owner IS NOT NULL GROUP BY gram HAVING count(DISTINCT owner) = 1",
    "phrase_fields": "SELECT row_id, " + ", ".join(rf"""coalesce(regexp_matches(lower("Nội dung"), '(^|[^\p{{L}}\p{{N}}_]){p}($|[^\p{{L}}\p{{N}}_])'), false) AS p{i}""" for i, p in enumerate(["học phí", "phí", "hồ sơ"])) + " FROM admissions",
    "normalised_forms": f"""WITH s AS (SELECT row_id, "Chủ đề" AS t, replace(lower("Chủ đề"), 'đ', 'd') AS d FROM admissions)
    SELECT row_id, {_FOLDED.format("nfc_normalize(lower(t))")} AS header_form, {_FOLDED.format("strip_accents(d)")} AS plain_words, {_WORDS.format("regexp_replace(strip_accents(lower(t)), '[^" + chr(92) + "x00-" + chr(92) + "x7F]+', '', 'g')", "")} AS ascii_words,
    {_WORDS.format("strip_accents(d)", ".,")} AS graded_words, regexp_replace(strip_accents(d), '[^{chr(92)}p{{L}}{chr(92)}p{{N}}]+', '', 'g') AS compact_letters FROM s""",
    "scalar_forms": r"""WITH t AS (SELECT row_id, coalesce("Chủ đề", '') AS topic, coalesce("Nội dung", '') AS content FROM admissions),
    v AS (SELECT *, regexp_replace(topic, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS ts FROM t),
    u AS (SELECT *, upper(substr(ts, 1, 1)) || lower(substr(ts, 2)) AS ti FROM v)
    SELECT row_id, CASE WHEN length(ti) > 35 THEN substr(ti, 1, 35) || '...' ELSE ti END AS title,
    replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, regexp_full_match(topic, '[\x00-\x7F]*') AS ascii FROM u""",
}
