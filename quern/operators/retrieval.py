"""Retrieval over tables: vector top-k, merging, cut-offs, decisions, record lookup and rendering.

Models stay outside: embeddings and pair scores are columns, so every plan is deterministic. Orders are
total: each carries its tie-break. Null scores sort last; an empty input gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import ascii_words_col, ngrams, similarity_col, strip
from quern.session import shared_folder

#: Bytes of query vectors that one block carries to the tasks; more queries are searched block by block.
BLOCK_BYTES = 64 << 20


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _matrix(table: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the vectors as rows of a matrix."""
    ids = table.column(key).to_numpy().astype(np.int64)
    flat = table.column("embedding").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return ids, flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def _best(ids: np.ndarray, queries: np.ndarray, there: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> Iterator[pa.RecordBatch]:
    """The k best of some vectors for some queries; scored a few thousand vectors at a time."""
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
    for at in range(0, len(there), 8192):
        scores = np.round(queries @ vectors[at : at + 8192].T, digits)
        for q in range(len(ids)):
            s, v = np.concatenate([best[q][0], scores[q]]), np.concatenate([best[q][1], there[at : at + 8192]])
            if len(s) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                s, v = s[keep], v[keep]
                order = np.lexsort((v, -s))[:k]
                s, v = s[order], v[order]
            best[q] = (s, v)
    n = [len(s) for s, _ in best]
    if sum(n):
        columns = [np.repeat(ids, n), np.concatenate([v for _, v in best]), np.concatenate([s for s, _ in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _search(folder: str, blocks: list[int], k: int, digits: int):
    """Each task reads the blocks of queries from the shared folder, one at a time, for each ``BLOCK_BYTES`` of its vectors."""

    def read(block: int) -> tuple[np.ndarray, np.ndarray]:
        files, path = fs.FileSystem.from_uri(f"{folder}/block={block}")
        return _matrix(pq.read_table(path, columns=["query_id", "embedding"], filesystem=files, partitioning=None), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = read(blocks[0]) if len(blocks) == 1 else None
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            if held:
                there, vectors = _matrix(pa.Table.from_batches(held), "vec_id")
                for block in blocks:
                    yield from _best(*(only or read(block)), there, vectors, k, digits)
                held.clear()

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.nbytes for h in held) > BLOCK_BYTES:
                yield from found()
        yield from found()

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``query_id, vec_id, score, rank``: the k vectors of greatest dot product with each query, exactly.

    ``queries``: ``query_id, embedding``; ``vectors``: ``vec_id, embedding``, all of one length; null
    vectors are left out. The vectors are scanned once, whatever the number of queries; the queries lie in
    blocks of bounded size in the shared folder, where the tasks read them. What is shuffled is k rows per
    query for each ``BLOCK_BYTES`` of vectors. Scores are rounded to
    ``digits``; ties go to the smaller id.
    """
    rows = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    asked = queries.filter("query_id is not null and embedding is not null")
    shape = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not shape[0]:
        return vectors.limit(0).selectExpr("0L as query_id", "0L as vec_id", "0D as score", "0 as rank")
    blocks = -(-shape[0] // max(1, BLOCK_BYTES // (8 * max(1, shape[1] or 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    folder = re.sub(r"^file:/+", "file:///", f"{shared_folder(rows.sparkSession)}/queries-{uuid.uuid4().hex}")
    asked.select(F.col("query_id").cast("bigint"), F.col("embedding").cast("array<double>"), "block").repartition("block").write.partitionBy("block").parquet(folder)
    there = sorted(r[0] for r in asked.select("block").distinct().collect())
    found = rows.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(_search(folder, there, k, digits), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_chunk_topk(candidates: DataFrame, cutoff: float, k: int) -> DataFrame:
    """First ``k`` records of each query with a score of at least ``cutoff``, each by its best chunk.

    ``candidates``: ``query_id, record_id, vec_id, score``.
    """
    kept = candidates.filter(F.col("score") >= cutoff)
    chunk = Window.partitionBy("query_id", "record_id").orderBy(F.desc("score"), "vec_id")
    best = kept.withColumn("chunk", F.row_number().over(chunk)).filter("chunk = 1").drop("chunk")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidate_decisions(candidates: DataFrame, cutoff: float, k: int) -> DataFrame:
    """Why each candidate was kept or not, the first that holds: below_minimum_score, result_limit_reached, duplicate_record, kept."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    same = Window.partitionBy("query_id", "record_id").orderBy(F.desc("score"), "vec_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.row_number().over(same) == 1) & (F.col("score") >= cutoff)
    rows = candidates.withColumn("fresh", fresh).withColumn("ahead", F.coalesce(F.count_if("fresh").over(before), F.lit(0)))
    reason = (
        F.when(F.col("score") < cutoff, "below_minimum_score").when(F.col("ahead") >= k, "result_limit_reached").when(~F.col("fresh"), "duplicate_record").otherwise("kept")
    )
    return rows.withColumn("reason", reason).drop("fresh", "ahead")


def recover_low_scores(candidates: DataFrame, cutoff: float, k: int, least: int = 3) -> DataFrame:
    """Candidates above the cut-off, at most k; where none is, the best ``min(k, least)`` with their true scores."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    top = F.max("score").over(Window.partitionBy("query_id"))
    keep = F.when(F.col("top") >= cutoff, F.col("score") >= cutoff).otherwise(F.col("rank") <= min(k, least))
    return ranked.withColumn("top", top).filter(keep).withColumn("recovered", F.col("top") < cutoff).drop("top")


def merge_groups(groups: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per (request, record) over several query groups: the greatest score, on ties the first arrival.

    ``groups``: ``request_id, group_no, arrival, record_id, score``.
    """
    first = Window.partitionBy("request_id", "record_id").orderBy(F.desc("score"), "group_no", "arrival")
    best = groups.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "group_no", "arrival", "record_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def lookup_records(candidates: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Candidates with their records; a candidate without one is an error when the rows are read."""
    there = records.withColumn("__there", F.lit(True))
    joined = candidates.join(there, key, "left")
    missing = F.raise_error(F.concat(F.lit("no record for "), F.col(key).cast("string")))
    return joined.withColumn("__there", F.coalesce("__there", missing.cast("boolean"))).filter("__there").drop("__there")


def missing_records(candidates: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Ids of candidates that have no record."""
    return candidates.select(key).distinct().join(records.select(key), key, "left_anti")


def evidence(row_fields: list[tuple[str, str]], missing: str, blanks: tuple[str, ...] = ("", "nan", "không có thông tin")) -> list[Column]:
    """Public fields under their labels; a value that says nothing becomes the ``missing`` marker."""
    return [
        F.when(F.coalesce(F.lower(strip(F.col(f"`{key}`"))), F.lit("")).isin(*blanks), F.lit(missing)).otherwise(F.col(f"`{key}`")).alias(label)
        for key, label in row_fields
    ]


def public_columns(schema: list[str], excluded: list[str] | None = None) -> list[str]:
    """Schema without excluded fields; None excludes timestamps and addresses by default, [] nothing."""
    hidden = set(HIDDEN) if excluded is None else set(excluded)
    return [c for c in schema if c not in hidden]


# Fields that are hidden where a profile names none; least and most characters of a value in an excerpt, the
# number of fields that share it, its length; positions of an even sample.
HIDDEN = ("timestamp", "email", "email_address")
VALUE_LEAST, VALUE_MOST, VALUES, LONGEST, POSITIONS = 40, 400, 8, 1800, 8


def excerpt(fields: list[tuple[str, str]], longest: int | Column = LONGEST) -> Column:
    """``label: value`` lines of the filled fields, each value and the whole bounded with an ellipsis."""
    longest = F.lit(longest) if isinstance(longest, int) else longest
    value = {key: strip(F.col(f"`{key}`")) for key, _ in fields}
    filled = sum([F.when(F.coalesce(v, F.lit("")) != "", 1).otherwise(0) for v in value.values()], F.lit(0))
    limit = F.greatest(F.lit(VALUE_LEAST), F.least(F.lit(VALUE_MOST), F.floor(longest / F.greatest(F.lit(1), F.least(filled, F.lit(VALUES)))))).cast("int")
    lines = []
    for key, label in fields:
        v = value[key]
        cut = F.when(F.length(v) <= limit, v).otherwise(F.concat(F.substring(v, F.lit(1), limit), F.lit("…")))
        lines.append(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label + ": "), cut)))
    text = F.concat_ws("\n", *lines)
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.substring(text, F.lit(1), longest - 1), F.lit("…")))


def embedding_text(prefix: str, primary: Column, fields: list[tuple[str, Column]]) -> Column:
    """Prefix and primary entity, then one ``label: value`` line per filled field."""
    lines = [F.when(F.coalesce(strip(v), F.lit("")) != "", F.concat(F.lit(label + ": "), v)) for label, v in fields]
    return F.concat_ws("\n", F.concat(F.lit(prefix), primary), *lines)


def pack_documents(documents: Column) -> Column:
    """One document as an object, several under ``documents``."""
    return F.when(F.size(documents) == 1, F.to_json(documents[0])).otherwise(F.to_json(F.struct(documents.alias("documents"))))


def even_positions(n: int, count: int = POSITIONS) -> list[int]:
    """Evenly spread positions in ``n`` rows, first and last included."""
    return sorted({round(i * (n - 1) / (count - 1)) for i in range(count)}) if n > count else list(range(n))


def fuzzy_match(rows: DataFrame, phrases: list[str], least: float = 0.85) -> DataFrame:
    """``row_id, wanted, ratio`` of the texts (``row_id, text``) that hold a phrase or words like it, both as ``ascii_words``.

    A phrase that stands in the text, even within words, has ratio 1. Else the best window of as many
    words as the phrase counts, if it is at least ``least`` similar. Phrases without ASCII letters match nothing.
    """
    spelled = rows.sparkSession.range(1).select(F.array(*[ascii_words_col(F.lit(p)) for p in phrases]) if phrases else F.array().cast("array<string>")).first()[0]
    wanted = [w for w in dict.fromkeys(spelled) if w]
    if not wanted:
        return rows.select("row_id", F.lit("").alias("wanted"), F.lit(0.0).alias("ratio")).limit(0)
    texts = rows.filter("text is not null").select("row_id", ascii_words_col(F.col("text")).alias("text"))
    there = F.filter(F.array(*map(F.lit, wanted)), lambda w: F.contains(F.col("text"), w))
    whole = texts.select("row_id", F.explode(there).alias("wanted"), F.lit(1.0).alias("ratio"))
    by_length: dict[int, list[str]] = {}
    for w in wanted:
        by_length.setdefault(len(w.split(" ")), []).append(w)
    words = F.split("text", " ")
    windows = F.map_from_arrays(F.array(*map(F.lit, by_length)), F.array(*[ngrams(words, n, n) for n in by_length]))
    grams = texts.select("row_id", F.explode(windows).alias("n", "all")).select("row_id", F.explode("all").alias("gram"), "n")
    of_length = F.element_at(F.create_map(*[x for n, ws in by_length.items() for x in (F.lit(n), F.array(*map(F.lit, ws)))]), F.col("n"))
    pairs = grams.select("gram", "n").distinct().select("gram", "n", F.explode(of_length).alias("wanted"))
    alike = pairs.withColumn("ratio", similarity_col(F.col("wanted"), F.col("gram"))).filter(F.col("ratio") >= least)
    found = grams.join(alike, ["gram", "n"]).select("row_id", "wanted", F.round("ratio", 6).alias("ratio"))
    return whole.unionByName(found).groupBy("row_id", "wanted").agg(F.max("ratio").alias("ratio"))


def score_pairs(pairs: DataFrame, scorer, batch: int = 16) -> DataFrame:
    """``pair_id, logit`` from an injected scorer of (query, passage) lists; longest first, so batches are even.

    ``scorer`` is called in the tasks with lists of at most ``batch`` pairs and must return as many
    numbers; another count is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, p = b.column("query").to_pylist(), b.column("passage").to_pylist()
            order = sorted(range(len(q)), key=lambda i: -(len(q[i] or "") + len(p[i] or "")))
            out = [0.0] * len(q)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                got = list(scorer([(q[i], p[i]) for i in some]))
                if len(got) != len(some):
                    raise ValueError("the scorer returned another number of scores")
                for i, s in zip(some, got):
                    out[i] = float(s)
            yield pa.RecordBatch.from_arrays([b.column("pair_id"), pa.array(out, pa.float64())], names=["pair_id", "logit"])

    return pairs.select("pair_id", "query", "passage").mapInArrow(run, "pair_id bigint, logit double")
