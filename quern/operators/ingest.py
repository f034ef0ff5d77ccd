"""Ingestion of uploaded tables: clean, map, validate, identify, report.

A source table has text columns under its own headers. Whole-load rules (ambiguous or missing headers,
missing or repeated source ids, no usable row) raise ``IngestError``; row rules only skip the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import strip
from quern.operators.ordered import fragment, rank_rows
from quern.operators.schema_drift import fold_header

#: Position of the first data row in a file, after its header.
FIRST_ROW = 2


class IngestError(ValueError):
    """The whole load is refused; what was active stays so."""


def cell(value: Column) -> Column:
    """Trimmed text; missing is ''. Dates and timestamps become ISO text by the cast."""
    return F.coalesce(strip(value.cast("string")), F.lit(""))


def cleaned(df: DataFrame, position: str) -> DataFrame:
    """All cells but the position as trimmed text, without columns that are both unnamed and empty."""
    cols = [c for c in df.columns if c != position]
    out = df.select(F.col(f"`{position}`"), *[cell(F.col(f"`{c}`")).alias(c) for c in cols])
    unnamed = [c for c in cols if re.match(r"Unnamed:", c)]
    if unnamed:
        longest = out.agg(*[F.max(F.length(f"`{c}`")).alias(c) for c in unnamed]).first()
        out = out.drop(*[c for c in unnamed if not longest[c]])
    return out


def resolve_headers(headers: list[str], mapping: dict[str, str]) -> dict[str, str]:
    """Key to source header, both compared in folded form."""
    by: dict[str, str] = {}
    for h in headers:
        form = fold_header(h)
        if form in by:
            raise IngestError(f"ambiguous header: {h!r}")
        by[form] = h
    missing = [f"{label!r} ({key})" for key, label in mapping.items() if fold_header(label) not in by]
    if missing:
        raise IngestError("mapped headers are missing: " + ", ".join(missing))
    return {key: by[fold_header(label)] for key, label in mapping.items()}


def canonical_row(columns: list[str]) -> Column:
    """The canonical form of a row that content ids are made of.

    Columns in order of their names, each as name, unit separator, value, record separator; null is ''.
    """
    parts = [F.concat(F.lit(c + "\x1f"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("\x1e")) for c in sorted(columns)]
    return F.concat(*parts)


def content_ids(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Add ``record_id``: SHA-256 of the canonical row and, after a colon, the 1-based count of equal rows so far.

    Copies are counted over range fragments, so a row that makes up a third of the table is no single
    task's work.
    """
    hashed = df.withColumn("__digest", F.sha2(canonical_row(columns), 256))
    ranked = rank_rows(fragment(hashed, ["__digest"], order), ["__digest"], order, "__copy")
    numbered = F.concat("__digest", F.lit(":"), (F.col("__copy") + 1).cast("string"))
    return ranked.withColumn("record_id", numbered).select(*df.columns, "record_id")


def prepare(df: DataFrame, mapping: dict[str, str], primary: str, position: str, id_key: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, report, skipped) of a source table whose 1-based file positions stand in ``position``.

    Records: ``record_id``, the mapped keys and ``raw_json`` with the whole row. Report, one row:
    ``input_rows, indexed_rows, empty_rows, missing_primary, unmapped_columns``. Skipped: the positions of the
    rows without a primary entity, as a table since there may be many.
    """
    clean = cleaned(df, position)
    cols = [c for c in clean.columns if c != position]
    headers = resolve_headers(cols, mapping)
    if primary not in headers or {"record_id", "raw_json"} & set(headers):
        raise IngestError("the mapping lacks the primary key or uses a reserved one")
    empty = F.concat_ws("", *[F.col(f"`{c}`") for c in cols]) == ""
    lacks = F.col(f"`{headers[primary]}`") == ""
    report = clean.agg(
        F.count("*").alias("input_rows"),
        F.count_if(~empty & ~lacks).alias("indexed_rows"),
        F.count_if(empty).alias("empty_rows"),
        F.count_if(~empty & lacks).alias("missing_primary"),
    ).withColumn("unmapped_columns", F.array(*[F.lit(c) for c in cols if c not in headers.values()]).cast("array<string>"))
    usable = clean.filter(~empty & ~lacks)
    if usable.isEmpty():
        raise IngestError("no row has a primary entity")
    if id_key:
        ids = usable.groupBy(F.col(f"`{headers[id_key]}`").alias("id")).count()
        if not ids.filter("id = '' or count > 1").isEmpty():
            raise IngestError("a source id is missing or repeated")
        usable = usable.withColumn("record_id", F.col(f"`{headers[id_key]}`"))
    else:
        usable = content_ids(usable, cols, [position])
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]))
    return usable.select("record_id", *[F.col(f"`{h}`").alias(k) for k, h in headers.items()], raw.alias("raw_json")), report, clean.filter(~empty & lacks).select(position)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side`` and ``extra``; empty if both are equal multisets."""
    cols = a.columns
    counts = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1))).groupBy(*cols).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    return counts.select(*cols, F.when(F.col("__n") > 0, "left").otherwise("right").alias("side"), F.abs("__n").alias("extra"))
