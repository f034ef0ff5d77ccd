"""Streams of messages and turn events.

Event times come as timestamps without zone from Parquet; watermarks need instants, so they are cast.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import shared_folder


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: t.StructType) -> DataFrame:
    """Parquet files of a folder whose names match a glob, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def daily_counts(messages: DataFrame, ts: str = "created_at") -> DataFrame:
    return messages.filter(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per key and window, final once the watermark has passed; later rows are left out by it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


TURN_STATE = "events bigint, started boolean, ended boolean, failed boolean, answer string"


def turn_status(events: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """``request_id, status, answer`` of each turn once it ends: ok, error or, when it stays silent for ``patience_ms``, incomplete.

    Without patience an open turn stays in the state; a run over what is there now must not wait for it.

    ``events``: ``request_id, event, text``; ``event`` is start, chunk, error or end. The state of a turn is
    a few flags and the answer so far.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, started, ended, failed, answer = state.get if state.exists else (0, False, False, False, "")
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "error" if failed else "incomplete", answer)], columns=["request_id", "status", "answer"])
            return
        for b in batches:
            n += len(b)
            started |= bool((b["event"] == "start").any())
            ended |= bool((b["event"] == "end").any())
            failed |= bool((b["event"] == "error").any())
            answer += "".join(b.loc[b["event"] == "chunk"].sort_values("seq")["text"].fillna(""))
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], "error" if failed else "ok", answer)], columns=["request_id", "status", "answer"])
        else:
            state.update((n, started, ended, failed, answer))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)

    timeout = GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("request_id").applyInPandasWithState(step, "request_id string, status string, answer string", TURN_STATE, "append", timeout)


def turn_status_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table of events."""
    got = events.groupBy("request_id").agg(
        F.bool_or(F.col("event") == "end").alias("ended"), F.bool_or(F.col("event") == "error").alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col("event") == "chunk", F.struct("seq", F.coalesce("text", F.lit("")).alias("t"))))).alias("c"),
    )
    status = F.when(F.col("failed"), "error").when(F.col("ended"), "ok").otherwise("incomplete")
    return got.select("request_id", status.alias("status"), F.array_join(F.transform("c", lambda x: x["t"]), "").alias("answer"))


def answer_cache(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """``key, request_id, hit`` of each request (``key, request_id, at``, event time) of a stream.

    A request is a hit if an answer of its key was stored at most ``ttl_ms`` before; else its own answer is
    stored. A hit does not renew what is stored. The state of a key is the time of its answer, dropped once the
    watermark has passed its end, so that keys that come no more take no room.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "request_id"]).itertuples():
            at = r.at.value // 1_000_000
            hit = stored is not None and 0 <= at - stored <= ttl_ms
            stored = stored if hit else at
            out.append((key[0], r.request_id, hit))
        state.update((stored,))
        if (end := stored + ttl_ms + 1) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["key", "request_id", "hit"])

    schema = f"key {requests.schema['key'].dataType.simpleString()}, request_id {requests.schema['request_id'].dataType.simpleString()}, hit boolean"
    return requests.groupBy("key").applyInPandasWithState(step, schema, "stored bigint", "append", GroupStateTimeout.EventTimeTimeout)


def answer_cache_batch(requests: DataFrame, ttl_ms: int) -> DataFrame:
    """The same over a finished table: requests of a key are taken in order of ``at``, ``request_id``."""

    rows = requests.select("key", "request_id", "at", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"))
    schema = f"key {requests.schema['key'].dataType.simpleString()}, request_id {requests.schema['request_id'].dataType.simpleString()}, hit boolean"

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run = None, None
        for b in batches:
            hits = []
            for k, at in zip(b["key"], b["ms"]):
                if run is None or k != key:
                    key, run = k, None
                hit = run is not None and at - run <= ttl_ms
                run = run if hit else at
                hits.append(hit)
            yield pd.DataFrame({"key": b["key"], "request_id": b["request_id"], "hit": hits})

    # sorted within the partitions of the key: a key is followed by one task, a batch at a time
    return rows.repartition("key").sortWithinPartitions("key", "at", "request_id").mapInPandas(in_order, schema)


def merged_turns(events: DataFrame) -> DataFrame:
    """``request_id, user_prompt, answer, domain, state, status`` of each turn, from its message, interaction, state and routing events.

    ``events``: ``request_id, seq, event, text``; ``event`` is user, chunk, route, state, error, cancelled or end. Later
    routes and states take the place of earlier ones.
    """
    last = lambda kind: F.max_by("text", F.when(F.col("event") == kind, F.col("seq")))
    had = lambda kind: F.bool_or(F.col("event") == kind)
    chunks = F.array_sort(F.collect_list(F.when(F.col("event") == "chunk", F.struct("seq", F.coalesce("text", F.lit("")).alias("t")))))
    got = events.groupBy("request_id").agg(
        F.min_by("text", F.when(F.col("event") == "user", F.col("seq"))).alias("user_prompt"), chunks.alias("c"), last("route").alias("domain"), last("state").alias("state"),
        had("error").alias("e"), had("cancelled").alias("x"), had("end").alias("z"),
    )
    status = F.when(F.col("e"), "error").when(F.col("x"), "cancelled").when(F.col("z"), "ok").otherwise("incomplete")
    return got.select("request_id", "user_prompt", F.array_join(F.transform("c", lambda x: x["t"]), "").alias("answer"), "domain", "state", status.alias("status"))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> str:
    """Run a stream over what is there now into a Parquet folder (append) and return its path."""
    out = os.path.join(folder, f"out-{uuid.uuid4().hex[:8]}")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", os.path.join(folder, f"state-{uuid.uuid4().hex[:8]}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def run_complete(stream: DataFrame) -> DataFrame:
    """Run an aggregating stream over what is there now and return its complete result, kept in the shared folder."""
    folder = f"{shared_folder(stream.sparkSession)}/result-{uuid.uuid4().hex[:12]}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        done.append(number)
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch-{done[-1]}") if done else stream.sparkSession.createDataFrame([], stream.schema)
