"""Files around runs: uploads by content, recent and archived logs, jobs of workers, bundles of results, injected models."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import shutil
import time
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.snapshots import write_json

# Characters of a log's tail; format of session names; texts in one call of an embedding model.
TAIL, SESSION, TEXTS = 12_000, "%Y%m%dT%H%M%S_%fZ", 32


def store_upload(path: str, folder: str) -> str:
    """Keep a file under the digest of its content; a file that is there already is not written again."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            digest.update(part)
    target = os.path.join(folder, digest.hexdigest() + os.path.splitext(path)[1].lower())
    if not os.path.exists(target):
        os.makedirs(folder, exist_ok=True)
        shutil.copyfile(path, f"{target}.part")
        os.replace(f"{target}.part", target)
    return target


def sql_frame(spark: SparkSession, sql: str) -> DataFrame:
    """The result of a query; what is wrong with it is raised, not shown as an empty table."""
    return spark.sql(sql)


def session_time(name: Column) -> Column:
    """The instant in a session's name; null for other names."""
    return F.try_to_timestamp(F.regexp_replace(name, r"^(\d{8})T(\d{6})_(\d{1,6})Z$", "$1 $2.$3"), F.lit("yyyyMMdd HHmmss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"))


def recent_files(folder: str, pattern: str = "*.log", since: datetime | None = None, hours: float = 24.0) -> dict[str, str]:
    """Reader options for the files of a folder that are as new as its newest session, or as ``hours`` if there is none."""
    names = []
    for name in os.listdir(folder) if os.path.isdir(folder) else []:
        try:
            names.append(datetime.strptime(name, SESSION).replace(tzinfo=UTC))
        except ValueError:
            continue
    start = since or (max(names) if names else datetime.fromtimestamp(time.time() - hours * 3600, UTC))
    return {"modifiedAfter": start.strftime("%Y-%m-%dT%H:%M:%S"), "pathGlobFilter": pattern, "recursiveFileLookup": "true"}


def log_tail(logs: DataFrame, text: str, most: int = TAIL) -> DataFrame:
    """Logs, a file in a row, cut to their last characters."""
    return logs.withColumn(text, F.substring(text, -most, most))


def head(rows: DataFrame, order: list[str], most: int = 500) -> DataFrame:
    """The first rows in an order: a slice by definition."""
    return rows.orderBy(*order).limit(most)


def zip_lines(spark: SparkSession, path: str, suffix: str = ".log") -> DataFrame:
    """``archive, member, no, value``: the lines of the members of ZIP archives; each archive is read by one task, member by member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for member in (m for m in z.namelist() if m.endswith(suffix)):
                        with z.open(member) as f:
                            lines = [x.decode("utf-8", "replace").rstrip("\r\n") for x in f]
                        n = len(lines)
                        columns = [pa.array([name] * n, pa.string()), pa.array([member] * n, pa.string()), pa.array(range(1, n + 1), pa.int64()), pa.array(lines, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["archive", "member", "no", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, member string, no bigint, value string")


def append_events(events: DataFrame, folder: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(folder)


def event_sink(stream: DataFrame, folder: str, state: str):
    """A query that appends each batch of a stream of events once; unlike a bounded queue it drops none."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")  # a batch that is done again replaces itself

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def write_bundle(folder: str, tables: dict[str, DataFrame], summary: dict) -> str:
    """Tables of a run and a summary with their row counts; the summary is written last, so a bundle with one is whole."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(os.path.join(folder, name))
        counts[name] = df.sparkSession.read.parquet(os.path.join(folder, name)).count()
    write_json(os.path.join(folder, "summary.json"), {**summary, "rows": counts})
    return folder


def new_bundles(before: list[str], after: list[str]) -> list[str]:
    """Bundles that are there now and were not before."""
    return sorted(set(after) - set(before))


def list_jobs(folder: str, alive: Callable[[int], bool], now: Callable[[], str]) -> list[dict]:
    """States of jobs, newest first. An open job whose worker is gone is set to failed, in its file too."""
    out = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not name.endswith(".json"):
            continue
        path = os.path.join(folder, name)
        try:
            with open(path, encoding="utf-8") as f:
                job = json.load(f)
        except (OSError, ValueError):
            continue
        if not isinstance(job, dict):
            continue
        if job.get("status") in ("queued", "running") and isinstance(job.get("pid"), int) and not alive(job["pid"]):
            job |= {"status": "failed", "stage": "worker gone", "updated_at": now(), "error": "the worker ended before the job; what is active was not changed"}
            write_json(path, job)
        out.append(job)
    return sorted(out, key=lambda j: (j.get("created_at") or "", j.get("id") or ""), reverse=True)


def revision(profile: dict, paths: list[str], settings: dict[str, str]) -> str:
    """Identity of a dataset's state: its profile, its settings, and size and time of its files."""
    parts = [json.dumps(profile, sort_keys=True, ensure_ascii=False), json.dumps(settings, sort_keys=True)]
    for p in paths:
        if os.path.exists(p):
            stat = os.stat(p)
            parts.append(f"{p}:{stat.st_size}:{stat.st_mtime_ns}")
    return hashlib.sha256("\x1e".join(parts).encode()).hexdigest()


def valid_trace(header: Column) -> Column:
    """A trace id handed on in a header: 16 hexadecimal digits, else null."""
    return F.when(header.rlike("^[0-9a-f]{16}$"), header)


def timed(task: str, emit: Callable[[dict], None]):
    """Decorator: an event when a call starts and one when it ends, with milliseconds and outcome; errors go on."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(*args, **kwargs):
            began, error = time.perf_counter(), None
            emit({"task": task, "event": "start"})
            try:
                return f(*args, **kwargs)
            except BaseException as e:
                error = type(e).__name__
                raise
            finally:
                emit({"task": task, "event": "end", "elapsed_ms": round((time.perf_counter() - began) * 1000, 3), "status": "ok" if error is None else "error", "error": error})

        return call

    return wrap


def staged(steps: list[tuple[str, Callable]], value: object, progress: Callable[[str], None]) -> object:
    """Run steps one after the other on a value, and tell each one's name before it begins."""
    for name, step in steps:
        progress(name)
        value = step(value)
    return value


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], size: int, batch: int = TEXTS) -> DataFrame:
    """``id, embedding`` of texts (``id, text``) by an injected model, called in the tasks with at most ``batch`` texts. Null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[list[float]] = []
            for at in range(0, len(b), batch):
                some = b["text"].iloc[at : at + batch].tolist()
                got = [list(map(float, v)) for v in model(some)]
                if len(got) != len(some) or any(len(v) != size for v in got):
                    raise ValueError("the model returned another number or size of vectors")
                out += got
            yield pd.DataFrame({"id": b["id"], "embedding": out})

    kept = texts.filter(F.col("text").rlike(r"\S")).select("id", "text")
    return kept.mapInPandas(run, f"id {kept.schema['id'].dataType.simpleString()}, embedding array<float>")


def replies(prompts: DataFrame, model: Callable[[str], str], fallback: str) -> DataFrame:
    """``id, reply`` of prompts (``id, prompt``) by an injected model; a call that fails gives the fallback."""

    def one(prompt: str | None) -> str:
        try:
            got = model(prompt) if prompt is not None else fallback
        except Exception:  # noqa: BLE001 - whatever the model does, the row has a reply
            return fallback
        return got if isinstance(got, str) else fallback

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "reply": [one(p) for p in b["prompt"]]})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, reply string")
