"""Queries of the general problems 1 and 4 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import packed_values, schema_drift
from quern.session import read_table

PACKED = (("admissions", "Hồ sơ"), ("workshop_services", "Kênh đăng ký"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = schema_drift.schema_changes(read_table(spark, sf, "ingestion_jobs"), read_table(spark, sf, "raw_records"))
    return changes.select("job_id", "field_name", "change_kind").distinct()


def p1_changes(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.schema_changes(read_table(spark, sf, "ingestion_jobs"), read_table(spark, sf, "raw_records"))


def p1_unified(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.unified_records(read_table(spark, sf, "ingestion_jobs"), read_table(spark, sf, "raw_records"))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    tables = [(t, read_table(spark, sf, t), F.col("row_id"), F.col(f"`{c}`")) for t, c in PACKED]
    return packed_values.split_columns(tables).withColumnRenamed("field", "table_name")


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).drop("items")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).filter("items > 1").select("table_name", "row_id", "item_no")


QUERIES = {"p1_found": p1_found, "p1_changes": p1_changes, "p1_unified": p1_unified, "p4_found": p4_found, "p4_values": p4_values}
