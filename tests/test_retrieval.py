import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval as r

CAND = "query_id bigint, record_id bigint, vec_id bigint, score double"
FIVE = [(1, 10, 1, 0.98), (1, 10, 2, 0.95), (1, 11, 3, 0.88), (1, 12, 4, 0.73), (1, 13, 5, 0.01)]


@pytest.mark.parametrize("block", [1, 3000, 1 << 20])
def test_topk_matches_brute_force_in_any_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(r, "BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 8)).astype(np.float32)
    v[7] = v[3]
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]], "x") for i in range(150)], "vec_id bigint, embedding array<float>, score string").repartition(5)
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for x in r.vector_topk(queries, rows, 6).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    for q in range(0, 150, 20):
        s = np.round(v.astype(np.float64) @ v[q].astype(np.float64), 6)
        order = sorted(range(150), key=lambda i: (-s[i], i))[:6]
        assert [i for i, _ in got[q]] == order
        assert np.allclose([x for _, x in got[q]], s[order])


def test_topk_without_rows_or_with_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(x.query_id, x.vec_id) for x in r.vector_topk(queries, rows, 5).collect()] == [(1, 1)]
    assert r.vector_topk(queries.limit(0), rows, 5).count() == 0
    assert r.vector_topk(queries, rows.limit(0), 5).count() == 0


def test_best_chunks_and_decisions(spark):
    df = spark.createDataFrame(FIVE, CAND)
    assert [(x.record_id, x["rank"]) for x in r.best_chunk_topk(df, 0.1, 2).orderBy("rank").collect()] == [(10, 1), (11, 2)]
    got = r.candidate_decisions(df, 0.1, 2).orderBy("vec_id").collect()
    assert [x.reason for x in got] == ["kept", "duplicate_record", "kept", "result_limit_reached", "below_minimum_score"]


def test_low_score_recovery(spark):
    low = [(1, i, i, s) for i, s in enumerate((0.004, 0.003, 0.002, 0.001))]
    some = [(2, 9, 9, 0.5), (2, 8, 8, 0.001)]
    got = r.recover_low_scores(spark.createDataFrame(low + some, CAND), 0.01, 5).collect()
    assert sorted((x.query_id, x.vec_id, x.recovered) for x in got) == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 9, False)]


def test_merge_keeps_greatest_score_and_first_arrival(spark):
    rows = [(1, 0, 1, "a", 0.0), (1, 1, 1, "b", 0.0), (1, 1, 2, "a", 0.0), (1, 2, 1, "c", 0.9), (1, 2, 2, "b", 0.5)]
    got = r.merge_groups(spark.createDataFrame(rows, "request_id int, group_no int, arrival int, record_id string, score double")).orderBy("rank").collect()
    assert [(x.record_id, x.score, x.group_no) for x in got] == [("c", 0.9, 2), ("b", 0.5, 2), ("a", 0.0, 0)]


def test_lookup_is_strict(spark):
    df, recs = spark.createDataFrame([(1, "x")], "record_id bigint, q string"), spark.createDataFrame([(1, "r")], "record_id bigint, text string")
    assert r.lookup_records(df, recs).collect() == [(1, "x", "r")]
    with pytest.raises(Exception, match="no record for 2"):
        r.lookup_records(df.union(spark.createDataFrame([(2, "y")], df.schema)), recs).collect()


def test_excerpt_and_evidence(spark):
    df = spark.createDataFrame([("T" * 500, " ", None, "v"), ("a", "b", "nan", "Không có thông tin")], "t string, b string, c string, d string")
    got = [x[0] for x in df.select(r.excerpt([("t", "Title"), ("b", "B"), ("c", "C"), ("d", "D")], 1800)).collect()]
    assert got[0] == "Title: " + "T" * 400 + "…\nD: v"
    short = [x[0] for x in df.select(r.excerpt([("t", "Title")], 60)).collect()]
    assert len(short[0]) == 60 and short[0].endswith("…")
    row = df.select(*r.evidence([("b", "B"), ("c", "C"), ("d", "D")], "-")).collect()
    assert [tuple(x) for x in row] == [("-", "-", "v"), ("b", "-", "-")]
    assert r.public_columns(["a", "email", "timestamp"]) == ["a"] and r.public_columns(["a", "email"], []) == ["a", "email"]


def test_pair_scores_by_injected_scorer(spark):
    df = spark.createDataFrame([(i, "q", "p" * i) for i in range(40)], "pair_id bigint, query string, passage string").repartition(3)
    got = {x.pair_id: x.logit for x in r.score_pairs(df, lambda pairs: [len(p) for _, p in pairs]).collect()}
    assert got == {i: float(i) for i in range(40)}
    with pytest.raises(Exception, match="another number"):
        r.score_pairs(df, lambda pairs: [1]).collect()


def test_documents_positions_and_cosine(spark):
    df = spark.createDataFrame([([("a",)],), ([("a",), ("b",)],)], "d array<struct<x:string>>")
    assert [x[0] for x in df.select(r.pack_documents(F.col("d"))).collect()] == ['{"x":"a"}', '{"documents":[{"x":"a"},{"x":"b"}]}']
    assert r.even_positions(3) == [0, 1, 2] and r.even_positions(100) == [0, 14, 28, 42, 57, 71, 85, 99]
    v = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert v.select(r.cosine(F.col("a"), F.col("b"))).first()[0] == 1.0


def test_fuzzy_match_takes_every_phrase_at_its_own_length(spark):
    import difflib

    import re
    import unicodedata

    from quern.plans.retrieval_queries import FORMS

    def ascii_words(text):
        kept = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if c.isascii())
        return " ".join(re.findall(r"\w+", kept))

    texts = ["Xét tuyển đợt 2", "xet tuyem", "Đề án tuyển sinh", "de an tuyen sinhh 2025", "tuyển sinh", "học bỗng", "họcphí, thủ-tục", "xhoc phix", "tục thủ", "", None, "phí", "học"]
    got = {(x.row_id, x.wanted): x.ratio for x in r.fuzzy_match(spark.createDataFrame(list(enumerate(texts)), "row_id bigint, text string"), [*FORMS, "phí", "đ"]).collect()}
    want = {}
    for i, text in enumerate(texts):
        plain = ascii_words(text or "")
        for w in filter(None, map(ascii_words, [*FORMS, "phí", "đ"])):
            words, n = plain.split(), len(w.split())
            best = max([difflib.SequenceMatcher(None, w, " ".join(words[k : k + n])).ratio() for k in range(len(words) - n + 1)], default=0.0)
            if w in plain or best >= 0.85:
                want[i, w] = 1.0 if w in plain else round(best, 6)
    assert got == want
    assert {(0, "xet tuyen"), (1, "xet tuyen"), (2, "e an tuyen sinh"), (3, "e an tuyen sinh"), (6, "phi"), (7, "hoc phi")} <= set(got)
    assert r.fuzzy_match(spark.createDataFrame([(1, "a")], "row_id bigint, text string"), ["đ"]).count() == 0
