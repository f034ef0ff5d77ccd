"""Queries of the problems on training text over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, conversations, mojibake, packing, pair_defects, personal_info, visual_forms
from quern.session import read_table


def _visual_rows(spark: SparkSession, sf: str) -> DataFrame:
    messages, admissions = read_table(spark, sf, "messages"), read_table(spark, sf, "admissions")
    parts = [("messages", messages, F.col("id"), "content")]
    parts += [("admissions", admissions, F.col("row_id"), field) for field in ("Chủ đề", "Nội dung")]
    return visual_forms.text_rows(parts)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual_forms.disguised(_visual_rows(spark, sf))


def p2_plain(spark: SparkSession, sf: str) -> DataFrame:
    return visual_forms.forms(_visual_rows(spark, sf)).select("table_name", "row_id", "field_name", "plain")


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return visual_forms.look_alikes(_visual_rows(spark, sf))


def _personal_rows(spark: SparkSession, sf: str) -> DataFrame:
    parts = [(t, read_table(spark, sf, t), F.col("id"), c) for t, c in (("messages", "content"), ("audit_logs", "user_query"), ("conversations", "location"))]
    return visual_forms.text_rows(parts)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_info.found(_personal_rows(spark, sf))


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _personal_rows(spark, sf).withColumnRenamed("field_name", "field")
    return personal_info.redacted(rows)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.dropped(read_table(spark, sf, "messages"), read_table(spark, sf, "conversations"))


def p5_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.rebuilt(read_table(spark, sf, "messages"), read_table(spark, sf, "conversations"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    logs = read_table(spark, sf, "audit_logs")
    return pair_defects.defects(logs, F.col("id"), F.col("user_query"), F.col("llm_final_response"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(read_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = bpe.token_counts(read_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"))
    return packing.pack(sizes, read_table(spark, sf, "context_windows"))


def p8_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p8_use(spark: SparkSession, sf: str) -> DataFrame:
    return packing.use_of(_packed(spark, sf), read_table(spark, sf, "context_windows"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.garbled(read_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), F.col("lang"))


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    out = mojibake.restored(read_table(spark, sf, "documents"), F.col("doc_id"), F.col("text"), F.col("lang"))
    return out.filter("garbled").select("doc_id", "restored", "chains", "whole")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_plain, p2_groups, p3_found, p3_redacted, p5_found, p5_conversations, p6_found, p7_ids, p8_windows, p8_use, p9_found, p9_restored)
}
