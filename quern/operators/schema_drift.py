"""Problem 1: schemas that drift between the files of a domain.

Each job carries a profile that maps keys to source headers; each of its records is a JSON object keyed
by source header. Columns are profiled per job (counts of value kinds and a min-wise sketch of the
values), consecutive jobs of a domain are matched column by column with an optimal assignment over
key, header, name and sketch similarity, and the matches give both the report of changes and the
column names under which all records are read into one table.

Edge cases, all covered by tests: rows with equal ``id`` / ``row_id`` count once; profiles that are null,
cut off, not objects or without a mapping are passed over; records that are not JSON objects have no
fields; a job without records has no kinds and hence no ``type_changed``; jobs with equal instants
follow each other by ``id``; jobs whose ``created_at`` cannot be read come first; rows without id or
domain have no place in an order and are left out; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import fragment, hot_join, lag_rows, once_each
from quern.session import cut_lineage

SKETCH = 8
KINDS = ("text", "number", "boolean", "list")
_PERMUTE = [(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1), 0xD1B54A32D192ED03 * (i + 3) & (2**64 - 1)) for i in range(SKETCH)]
_FIELD = "array<struct<key:string,header:string>>"
_STATS = [*(f"n_{k}" for k in KINDS), *(f"s{i}" for i in range(SKETCH))]


def fold_header(text: str) -> str:
    """A header without differences of Unicode composition, spacing or letter case."""
    return " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()).split())


def value_kind(value: object) -> str | None:
    """text, number, boolean or list; None for null, the empty string and values of other shapes."""
    if value is None or value == "":
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "text"
    return "list" if isinstance(value, list) else None


def read_mapping(profile: str | None) -> list[tuple[str, str]] | None:
    """(key, header) of ``schema_mapping``, or None if the profile can't be read."""
    try:
        mapping = json.loads(profile)["schema_mapping"] if profile else None
    except (ValueError, KeyError, TypeError):
        return None
    return [(k, v) for k, v in mapping.items() if isinstance(v, str)] if isinstance(mapping, dict) else None


def read_body(body: str | None) -> dict:
    try:
        got = json.loads(body) if body else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def _parse_jobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        maps = [read_mapping(p) for p in b["profile"]]
        keep = [m is not None for m in maps]
        yield b.loc[keep, ["id", "domain", "at"]].assign(fields=[[{"key": k, "header": h} for k, h in m] for m in maps if m is not None])


def readable_jobs(jobs: DataFrame) -> DataFrame:
    """``id, domain, at, fields``: one row per job with a readable profile."""
    rows = jobs.select("id", "domain", F.expr("try_cast(created_at as timestamp)").alias("at"), "profile")
    rows = rows.filter("id is not null and domain is not null and profile is not null").dropDuplicates(["id"])
    return rows.mapInPandas(_parse_jobs, f"id string, domain string, at timestamp, fields {_FIELD}")


def sketch_values(groups: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` groups the smallest image of its hashes under each of the fixed permutations, as signed numbers."""
    out = np.full((n, SKETCH), np.iinfo(np.int64).max)
    x = hashes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(_PERMUTE):
            np.minimum.at(out[:, i], groups, (x * np.uint64(a) + np.uint64(b)).view(np.int64))
    return out


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folded: dict[str, str] = {}
    for b in batches:
        group_of: dict[tuple[str, str], int] = {}
        groups, kinds, hashes = [], [], []
        for job, body in zip(b.column("job_id").to_pylist(), b.column("body").to_pylist()):
            for header, value in read_body(body).items():
                if (kind := value_kind(value)) is None:
                    continue
                h = folded.get(header)
                if h is None:
                    h = folded[header] = fold_header(header)
                groups.append(group_of.setdefault((job, h), len(group_of)))
                kinds.append(KINDS.index(kind))
                hashes.append(xxhash.xxh64_intdigest(value if isinstance(value, str) else json.dumps(value)))
        n, at = len(group_of), np.array(groups, dtype=np.int64)
        counts = np.zeros((n, len(KINDS)), dtype=np.int64)
        np.add.at(counts, (at, np.array(kinds, dtype=np.int64)), 1)
        sketches = sketch_values(at, np.array(hashes, dtype=np.uint64), n)
        columns = [pa.array([j for j, _ in group_of], pa.string()), pa.array([h for _, h in group_of], pa.string())]
        columns += [pa.array(np.ascontiguousarray(x)) for x in (*counts.T, *sketches.T)]
        yield pa.RecordBatch.from_arrays(columns, names=["job_id", "header", *_STATS])


def column_profiles(records: DataFrame) -> DataFrame:
    """``job_id, header`` (folded)``, n_<kind>..., s0...``: kinds and value sketch of every column of every job.

    Batches are profiled where they lie, so a job with a third of all records sends only a few partial
    rows for each of its columns to the one task that adds them up.
    """
    rows = once_each(records.select("row_id", "job_id", "body").filter("job_id is not null"), "row_id")
    parts = rows.select("job_id", "body").mapInArrow(_profile_batches, "job_id string, header string, " + ", ".join(f"{c} bigint" for c in _STATS))
    sums = [F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS]
    return parts.groupBy("job_id", "header").agg(*sums, *[F.min(f"s{i}").alias(f"s{i}") for i in range(SKETCH)])


@lru_cache(maxsize=1 << 14)
def _tokens(name: str) -> frozenset[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", name.casefold().replace("đ", "d")) if not unicodedata.combining(c))
    return frozenset(re.findall(r"[a-z0-9]+", plain))


def _overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def main_kind(counts: list[int] | None) -> str | None:
    """The kind most values have; the first of KINDS on a tie."""
    return KINDS[counts.index(max(counts))] if counts and max(counts) else None


def similarity(a: dict, b: dict) -> float:
    """How likely column ``a`` of a job is column ``b`` of the next. A shared header outweighs a shared key, and either outweighs likeness."""
    alike = 0.3 * max(_overlap(_tokens(a["key"]), _tokens(b["key"])), _overlap(_tokens(a["header"]), _tokens(b["header"])))
    if a["sketch"] and b["sketch"]:
        alike += 0.4 * sum(x == y for x, y in zip(a["sketch"], b["sketch"])) / SKETCH
    alike += 0.1 * (a["kind"] is not None and a["kind"] == b["kind"])
    return 4.0 * (a["header"] == b["header"]) + 3.0 * (a["key"] == b["key"]) + alike


def assign(weights: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of greatest weight (shortest augmenting paths); -1 where there is none."""
    n, m = len(weights), len(weights[0]) if weights else 0
    size = max(n, m)
    cost = [[-weights[i][j] if i < n and j < m else 0.0 for j in range(size)] for i in range(size)]
    u, v, owner = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        owner[0], j0 = i, 0
        least, came, done = [math.inf] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while True:
            done[j0], i0, delta, j1 = True, owner[j0], math.inf, 0
            for j in range(1, size + 1):
                if not done[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], came[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    out = [-1] * n
    for j in range(1, size + 1):
        if owner[j] <= n and j <= m:
            out[owner[j] - 1] = j - 1
    return out


def match_fields(old: list[dict], new: list[dict], likeness: float) -> list[tuple[int, int]]:
    """Pairs of positions in ``old`` and ``new`` that are one column. Without a shared key or header, a pair needs ``likeness``.

    A column with key and header unchanged, neither of which another column has, is in every best
    assignment: giving it up loses more than all other pairs of the two columns could gain.
    """
    def unique(side: list[dict]) -> dict[tuple[str, str], int]:
        keys, headers = Counter(c["key"] for c in side), Counter(c["header"] for c in side)
        return {(c["key"], c["header"]): i for i, c in enumerate(side) if keys[c["key"]] == 1 and headers[c["header"]] == 1}

    a, b = unique(old), unique(new)
    same = [(a[k], b[k]) for k in a.keys() & b.keys()]
    rest_old, rest_new = sorted(set(range(len(old))) - {i for i, _ in same}), sorted(set(range(len(new))) - {j for _, j in same})
    if rest_old and rest_new:
        w = [[similarity(old[i], new[j]) for j in rest_new] for i in rest_old]
        same += [(rest_old[i], rest_new[j]) for i, j in enumerate(assign(w)) if j >= 0 and w[i][j] >= likeness]
    return same


def _columns(fields: list[dict], profiles: list[dict] | None) -> list[dict]:
    by = {p["header"]: p["stats"] for p in profiles or []}
    out = []
    for f in fields:
        stats = by.get(h := fold_header(f["header"]))
        out.append({"key": f["key"], "header": h, "raw": f["header"], "kind": main_kind(stats and stats[: len(KINDS)]), "sketch": stats and stats[len(KINDS) :]})
    return out


_CHANGE = ("domain", "previous_job_id", "job_id", "field_name", "change_kind", "old_value", "new_value", "old_field")


def compare_jobs(domain: str, before: str, job: str, old: list[dict], new: list[dict], likeness: float) -> Iterator[tuple]:
    """Rows of ``_CHANGE``: what became of each column between two jobs, with ``kept`` for columns without change."""
    back = {j: i for i, j in match_fields(old, new, likeness)}
    keys, headers = {c["key"] for c in old}, {c["header"] for c in old}
    for j, c in enumerate(new):
        o = old[back[j]] if j in back else None
        exact = o is not None and (o["key"] == c["key"] or o["header"] == c["header"])
        if exact and (o["key"] != c["key"] or o["header"] != c["header"]):
            yield domain, before, job, c["key"], "renamed", f"{o['key']}: {o['raw']}", f"{c['key']}: {c['raw']}", o["key"]
        elif c["key"] not in keys and c["header"] not in headers:
            yield domain, before, job, c["key"], "added", o and f"{o['key']}: {o['raw']}", f"{c['key']}: {c['raw']}", o and o["key"]
        elif exact:
            yield domain, before, job, c["key"], "kept", None, None, o["key"]
        if exact and o["kind"] and c["kind"] and o["kind"] != c["kind"]:
            yield domain, before, job, c["key"], "type_changed", o["kind"], c["kind"], o["key"]
    keys, headers = {c["key"] for c in new}, {c["header"] for c in new}
    for c in old:
        if c["key"] not in keys and c["header"] not in headers:
            yield domain, before, job, c["key"], "removed", f"{c['key']}: {c['raw']}", None, c["key"]


def _compare(likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                out += compare_jobs(r["domain"], r["before"], r["id"], _columns(r["before_fields"], r["before_profiles"]), _columns(r["fields"], r["profiles"]), likeness)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(len(_CHANGE))], names=list(_CHANGE))

    return run


def job_sequence(jobs: DataFrame) -> DataFrame:
    """Readable jobs with the id of the one before in the domain (``before``), also where one domain holds most jobs."""
    order = fragment(jobs.select("id", "domain", "at"), ["domain"], ["at", "id"])
    return lag_rows(order, ["domain"], ["at", "id"], F.col("id"), "before").select("id", "domain", "at", "before")


def drift(jobs: DataFrame, records: DataFrame, likeness: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(all column matches and changes, readable jobs). ``likeness``: least similarity of a pair that shares neither key nor header."""
    read = cut_lineage(readable_jobs(jobs))
    stats = column_profiles(records)
    packed = stats.groupBy("job_id").agg(F.collect_list(F.struct("header", F.array(*_STATS).alias("stats"))).alias("profiles"))
    sides = cut_lineage(read.join(packed, read.id == packed.job_id, "left").select("id", "fields", "profiles"))
    steps = job_sequence(read).filter("before is not null")
    new = sides.select("id", "fields", "profiles")
    old = sides.select(F.col("id").alias("before"), F.col("fields").alias("before_fields"), F.col("profiles").alias("before_profiles"))
    both = steps.join(new, "id").join(old, "before").select("domain", "before", "id", "fields", "profiles", "before_fields", "before_profiles")
    return both.mapInArrow(_compare(likeness), ", ".join(f"{c} string" for c in _CHANGE)), read


def schema_changes(jobs: DataFrame, records: DataFrame, likeness: float = 0.35) -> DataFrame:
    """One row per change between consecutive jobs of a domain: added, removed, renamed or type_changed.

    ``old_value``/``new_value`` are "key: header", or the kinds for ``type_changed``. An added column that
    resembles a removed one shows it as ``old_value``: a likely rename of both key and header.
    """
    changes, _ = drift(jobs, records, likeness)
    return changes.filter("change_kind <> 'kept'").select("domain", "previous_job_id", "job_id", "field_name", "change_kind", "old_value", "new_value")


def unified_names(jobs: DataFrame, records: DataFrame, likeness: float = 0.35) -> DataFrame:
    """``job_id, key, header`` (folded)``, field``: the name each column of each job has in the unified table.

    The name is the key under which the column first appeared in its domain; where several columns of a domain first
    appeared under one key, those after the first one have the job of their first appearance added. Columns point to
    their match in the job before; pointers are doubled until all point to a first appearance, so a domain with n
    jobs takes log n joins and no task follows a whole domain.
    """
    changes, read = drift(jobs, records, likeness)
    links = changes.filter("change_kind <> 'removed' and change_kind <> 'type_changed' and old_field is not null")
    links = links.select("job_id", F.col("field_name").alias("key"), F.col("previous_job_id").alias("to_job"), F.col("old_field").alias("to_key"))
    cols = read.select(F.col("id").alias("job_id"), F.inline("fields"))
    at = cut_lineage(
        cols.join(links, ["job_id", "key"], "left").select("job_id", "key", "header", F.coalesce("to_job", "job_id").alias("to_job"), F.coalesce("to_key", "key").alias("to_key"))
    )
    while True:
        nxt = at.select(F.col("job_id").alias("to_job"), F.col("key").alias("to_key"), F.col("to_job").alias("then_job"), F.col("to_key").alias("then_key"))
        moved = at.join(nxt, ["to_job", "to_key"]).select(
            "job_id", "key", "header", F.col("then_job").alias("to_job"), F.col("then_key").alias("to_key"), (~(F.col("then_job") == F.col("to_job")) | ~(F.col("then_key") == F.col("to_key"))).alias("moved")
        )
        moved = cut_lineage(moved)
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    origin = read.select(F.col("id").alias("to_job"), "domain", "at")
    lines = at.select("to_job", "to_key").distinct().join(origin, "to_job")
    earliest = lines.groupBy("domain", "to_key").agg(F.min(F.struct(F.col("at").isNotNull(), "at", "to_job")).alias("e")).select(F.col("domain").alias("d"), F.col("to_key").alias("k"), "e.to_job")
    first = lines.join(earliest.withColumnRenamed("to_job", "j"), (F.col("domain") == F.col("d")) & (F.col("to_key") == F.col("k")))
    names = first.select("to_job", "to_key", F.when(F.col("to_job") == F.col("j"), F.col("to_key")).otherwise(F.concat("to_key", F.lit("@"), "to_job")).alias("field"))
    return at.join(names, ["to_job", "to_key"]).select("job_id", "key", "header", "field")


class _Pairs(list):
    """The members of a JSON object in their order, repeated names included."""


def _pairs(body: str | None) -> list[tuple[str, object]]:
    try:
        got = json.loads(body, object_pairs_hook=_Pairs) if body else []
    except ValueError:
        return []
    return got if isinstance(got, _Pairs) else []


def _as_dicts(value: object) -> object:
    if isinstance(value, _Pairs):
        return {k: _as_dicts(v) for k, v in value}
    return [_as_dicts(v) for v in value] if isinstance(value, list) else value


def unify(body: str | None, field_of: dict[str, str]) -> tuple[dict[str, str | None], dict[str, str | None]]:
    """(fields, extra) of a record. Each value of the record is in one of both: a second value for a field, or for a name, goes
    to ``extra`` under its own header, numbered if need be."""
    fields: dict[str, str | None] = {}
    extra: dict[str, str | None] = {}
    for header, value in _pairs(body):
        text = value if isinstance(value, str) or value is None else json.dumps(_as_dicts(value), ensure_ascii=False)
        field = field_of.get(fold_header(header))
        if field is not None and field not in fields:
            fields[field] = text or None
            continue
        name, n = header, 1
        while name in extra:
            n += 1
            name = f"{header} ({n})"
        extra[name] = text or None
    return fields, extra


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for row_id, domain, job, line, body, names in b.itertuples(index=False):
            field_of: dict[str, str] = {}
            for n in sorted(names if names is not None else [], key=lambda n: (n["header"], n["field"])):
                field_of.setdefault(fold_header(n["header"]), n["field"])
            out.append((row_id, domain, job, line, *unify(body, field_of)))
        yield pd.DataFrame(out, columns=["row_id", "domain", "job_id", "line_no", "fields", "extra"])


def unified_records(jobs: DataFrame, records: DataFrame, likeness: float = 0.35) -> DataFrame:
    """All raw records in one table: ``row_id, domain, job_id, line_no, fields, extra``.

    ``fields`` maps unified names to values as text (lists as JSON, empty values as null), ``extra`` holds
    what no profile maps and what a field has a second time; no value is lost. Records of jobs without a readable profile have all their values in ``extra``.
    """
    names = unified_names(jobs, records, likeness).groupBy("job_id").agg(F.collect_list(F.struct("header", "field")).alias("names"))
    domains = jobs.select(F.col("id").alias("job_id"), "domain").filter("job_id is not null").dropDuplicates(["job_id"])
    of_job = cut_lineage(domains.join(names, "job_id", "full"))
    rows = once_each(records.select("row_id", "job_id", "line_no", "body"), "row_id")
    cells = hot_join(rows, of_job, ["job_id"], "left").select("row_id", "domain", "job_id", "line_no", "body", "names")
    return cells.mapInPandas(_cells, "row_id bigint, domain string, job_id string, line_no int, fields map<string,string>, extra map<string,string>")
