import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import selection

QUESTIONS = [(1, ["học phí", "phí kỳ", "học phí kỳ"]), (1, ["kỳ một"]), (2, ["học phí"]), (2, None), (None, ["học phí", "học phí kỳ"]), (3, ["hồ sơ", "hồ"]), (4, ["khác gì"])]
TITLES = [("A", ["học phí"]), ("A", ["học phí"]), ("B", ["học phí kỳ", "kỳ một"]), ("B", ["hồ sơ"]), ("C", ["hồ sơ", "hồ"]), (None, ["kỳ một", "phí kỳ"]), ("C", None)]


def brute_force():
    owners = {}
    for owner, phrases in TITLES:
        for p in phrases or []:
            owners.setdefault(p, set()).update({owner} - {None})
    told = {(q, p, *owners[p]) for q, phrases in QUESTIONS for p in phrases or [] if len(owners.get(p, ())) == 1}
    return {(q, o) for q, p, o in told if not any(q is not None and q == r and len(b) > len(p) and f" {p} " in f" {b} " for r, b, _ in told)}


@pytest.mark.parametrize("sent_bytes", [16 << 20, 0])
def test_specific_owners_sends_telling_phrases_only(spark, tmp_path, monkeypatch, sent_bytes):
    monkeypatch.setattr(selection, "SENT_BYTES", sent_bytes, raising=False)
    spark.createDataFrame(QUESTIONS, "question_id bigint, phrases array<string>").write.parquet(f"{tmp_path}/q")
    spark.createDataFrame(TITLES, "owner string, phrases array<string>").write.parquet(f"{tmp_path}/t")
    got = selection.specific_owners(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/t"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_force() == {(1, "B"), (2, "A"), (None, "A"), (None, "B"), (3, "C")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the questions are the left side: only the right may be sent
    assert ("BroadcastHashJoin" in plan and "BuildRight" in plan and "BuildLeft" not in plan) if sent_bytes else ("SortMergeJoin" in plan and "Broadcast" not in plan)


def test_words_are_computed_once_for_all_ngrams(spark):
    grams = spark.createDataFrame([("a b c d e",)], "x string").select(text.ngrams(text.tokens(F.col("x"))).alias("g"))
    assert len(grams.first().g) == 9 and grams._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
