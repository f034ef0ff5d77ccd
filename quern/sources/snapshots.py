"""Versioned dataset snapshots: write, check, then move the pointer; older generations stay for rollback."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quern.operators.ingest import IngestError
from quern.sources.files import Files

_ID = re.compile(r"[0-9a-f]{32}\Z")
_LOCK = "writer.lock"
_PARTS = ("records", "vectors", "profile.json", "report.json")


def write_json(path: str, value: object) -> None:
    """Replace a small JSON file at once; NaN is refused."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.remove(temporary)


class Snapshots:
    """Generations of one dataset under a folder, in any file system that all executors share."""

    def __init__(self, folder: str, stale_s: float = 86_400.0):
        self.folder, self.stale_s = folder.rstrip("/"), stale_s
        self.files = Files(self.folder)
        self.files.make()

    def path(self, generation: str, part: str) -> str:
        return f"{self.folder}/{generation}/{part}"

    def active(self) -> str | None:
        got = self.files.read_json("current.json")
        generation = got.get("generation") if isinstance(got, dict) else None
        return generation if isinstance(generation, str) and _ID.match(generation) else None

    def generations(self) -> list[str]:
        """Whole generations, newest first."""
        there = [g for g in self.files.names() if _ID.match(g) and all(self.files.exists(f"{g}/{p}") for p in _PARTS)]
        return sorted(there, key=lambda g: (self.files.modified_ms(f"{g}/report.json"), g), reverse=True)

    @contextmanager
    def lock(self):
        """One writer at a time; the lock is a file that only one can create. One older than ``stale_s`` is of a writer that is gone."""
        if not self.files.create(_LOCK):
            if time.time() * 1000 - self.files.modified_ms(_LOCK) < self.stale_s * 1000:
                raise IngestError("another writer is at work")
            self.files.remove(_LOCK)
            if not self.files.create(_LOCK):
                raise IngestError("another writer is at work")
        try:
            yield
        finally:
            self.files.remove(_LOCK)

    def publish(self, records: DataFrame, report: dict, profile: dict, vectors: Callable[[DataFrame], DataFrame] | None = None) -> str:
        """Write a new generation, check it and make it active. If anything fails, what was active stays so.

        ``vectors`` builds ``record_id, embedding...`` from the records; each record must have one.
        """
        generation = uuid.uuid4().hex
        with self.lock():
            try:
                spark = records.sparkSession
                records.write.parquet(self.path(generation, "records"))
                stored = spark.read.parquet(self.path(generation, "records"))
                if stored.count() != report["indexed_rows"]:
                    raise IngestError("not all records were stored")
                built = vectors(stored) if vectors else stored.select("record_id")
                built.write.parquet(self.path(generation, "vectors"))
                lacking = stored.select("record_id").join(spark.read.parquet(self.path(generation, "vectors")).select("record_id"), "record_id", "left_anti")
                if not lacking.isEmpty():
                    raise IngestError("records without a vector")
                self.files.write_json(f"{generation}/profile.json", profile)
                self.files.write_json(f"{generation}/report.json", report)
                self.files.write_json("current.json", {"generation": generation})
            except BaseException:
                self.files.remove(generation)
                raise
        return generation

    def rollback(self, generation: str) -> None:
        if generation not in self.generations():
            raise IngestError("no such generation")
        with self.lock():
            self.files.write_json("current.json", {"generation": generation})

    def read(self, spark: SparkSession, part: str = "records") -> DataFrame:
        if (generation := self.active()) is None:
            raise IngestError("nothing has been published")
        return spark.read.parquet(self.path(generation, part))


def archive(folder: str, into: str) -> str:
    """Move a dataset's folder into an archive with a manifest; on failure it is moved back."""
    source, target = Files(folder), Files(f"{into.rstrip('/')}/{folder.rstrip('/').rsplit('/', 1)[-1]}-{uuid.uuid4().hex[:8]}")
    Files(into).make()
    source.move_to(target)
    try:
        target.write_json("manifest.json", {"moved_from": folder})
    except BaseException:
        target.move_to(source)
        raise
    return target.folder
