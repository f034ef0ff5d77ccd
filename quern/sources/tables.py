"""Readers of uploaded tables: csv, tsv, json, jsonl and xlsx.

All cells are text; ``position`` is the 1-based place of a row in its file (the header is 1). Literal
``NA`` and leading zeros stay as they are.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quern.operators.ingest import FIRST_ROW, IngestError
from quern.operators.ordered import fragment, rank_rows
from quern.sources.sheets import sheet_rows

POSITION = "position"


def _place() -> list[Column]:
    """Where a row was read: its file, the offset of the part of the file, and its order within the part."""
    return [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__part"), F.monotonically_increasing_id().alias("__row")]


def read_upload(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One uploaded file as a table of text columns and ``position``, by its suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix in (".csv", ".tsv"):
        return _delimited(spark, path, "\t" if suffix == ".tsv" else ",")
    if suffix == ".jsonl":
        return _numbered(_flat(spark.read.option("mode", "FAILFAST").option("primitivesAsString", "true").json(path)))
    if suffix == ".json":
        rows = _flat(spark.read.option("mode", "FAILFAST").option("primitivesAsString", "true").option("multiLine", "true").json(path))
        if rows.isEmpty():
            raise IngestError("a JSON file must hold a list of at least one row")
        return _numbered(rows)
    if suffix in (".xlsx", ".xlsm"):
        return _sheet(spark, path, sheet)
    raise IngestError(f"no reader for {suffix!r}: csv, tsv, json, jsonl and xlsx are read")


def _header(spark: SparkSession, path: str, separator: str) -> list[str]:
    """The header as written; Spark's own reader would rename headers that differ in case only."""
    raw = spark.read.option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", "true").option("header", "false").option("inferSchema", "false").csv(path).first()
    if raw is None:
        raise IngestError("the file has no header")
    names = [(c or "").lstrip("﻿") for c in raw]
    names = [n if n.strip() else f"Unnamed: {i}" for i, n in enumerate(names)]
    if len(set(names)) < len(names):
        raise IngestError("the same header stands twice")
    return names


def _delimited(spark: SparkSession, path: str, separator: str) -> DataFrame:
    names = _header(spark, path, separator)
    inner = t.StructType([t.StructField(f"c{i}", t.StringType()) for i in range(len(names))])
    rows = (
        spark.read.schema(inner).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", "true").option("header", "true").option("enforceSchema", "true")
        .option("nullValue", "").option("emptyValue", "").option("mode", "FAILFAST").csv(path)
    )
    return _numbered(rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *_place()))


def _flat(rows: DataFrame) -> DataFrame:
    nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, (t.ArrayType, t.StructType, t.MapType))]
    if nested:
        raise IngestError("nested values must be flattened first: " + ", ".join(nested))
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns], *_place())


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions in each file, however files were split or read together: parts follow their offsets, rows their order in a part."""
    order = ["__part", "__row"]
    ranked = rank_rows(fragment(rows, ["__file"], order), ["__file"], order, POSITION)
    names = [c for c in rows.columns if c not in ("__file", *order)]
    return ranked.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names], (F.col(POSITION) + FIRST_ROW).alias(POSITION))


def _sheet(spark: SparkSession, path: str, sheet: int | str) -> DataFrame:
    rows = sheet_rows(spark, path, sheet)
    top = rows.filter(F.col("position") == FIRST_ROW - 1).first()
    if top is None:
        raise IngestError("the sheet has no header")
    names = [n if n.strip() else f"Unnamed: {i}" for i, n in enumerate(top["cells"])]
    if len(set(names)) < len(names):
        raise IngestError("the same header stands twice")
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return rows.filter(F.col("position") >= FIRST_ROW).select(*cells, POSITION)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback lines; malformed ones are passed over."""
    schema = "timestamp string, rating int, instruction string, input string, output string, rag_context array<string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_events(spark: SparkSession, path: str, prefix: str = "TIMING ") -> DataFrame:
    """Events of log files: JSON after ``prefix`` or JSON lines; other lines are passed over.

    Known fields are columns, ``raw`` keeps the open ones.
    """
    lines = spark.read.text(path)
    cut = F.expr(f"instr(value, '{prefix}')")
    body = F.when(cut > 0, F.substring("value", cut + len(prefix), F.lit(1 << 30))).otherwise(F.col("value"))
    known = "request_id string, pid bigint, task string, event string, elapsed_ms double, status string, error string, cache_hit boolean"
    rows = lines.select(F.trim(body).alias("raw")).filter(F.col("raw").startswith("{"))
    parsed = rows.withColumn("e", F.from_json("raw", known)).filter(F.expr("try_parse_json(raw) is not null"))
    return parsed.select("e.*", "raw")


def read_frames(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """``stream_id, answer, metadata, done, errors`` of server-sent event lines.

    ``lines``: ``stream_id, seq, line``. Data lines hold ``[DONE]`` or JSON with ``content``, ``metadata``
    or ``error``; a line that is neither counts as an error. A stream's lines are bounded by one answer.
    """
    data = lines.filter(F.col("line").startswith("data:")).withColumn("d", F.trim(F.substring("line", 6, 1 << 30)))
    done = F.col("d") == "[DONE]"
    bad = ~done & F.expr("try_parse_json(d) is null")
    parts = data.select(
        "stream_id", "seq", done.alias("done"), F.when(~done, F.get_json_object("d", "$.content")).alias("content"), F.when(~done, F.get_json_object("d", "$.metadata")).alias("metadata"),
        F.when(bad, F.col("d")).when(~done, F.get_json_object("d", "$.error")).alias("error"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("c"))))
    return parts.groupBy("stream_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["c"]), "").alias("answer"), F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("seq"))).alias("metadata"),
        F.bool_or("done").alias("done"), F.array_compact(F.collect_list("error")).alias("errors"),
    )


def read_json_records(path: str) -> list[dict]:
    """Small control files (job states, pointers) on the driver; unreadable ones are passed over."""
    out = []
    for name in sorted(os.listdir(path)) if os.path.isdir(path) else []:
        if name.endswith(".json"):
            try:
                with open(os.path.join(path, name), encoding="utf-8") as f:
                    got = json.load(f)
            except (OSError, ValueError):
                continue
            if isinstance(got, dict):
                out.append(got)
    return out
