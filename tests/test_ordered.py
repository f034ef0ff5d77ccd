"""Look-backs, ranks, frames and percentiles over keys of any size, against plain Python."""

import random

from pyspark.sql import functions as F

from quern.operators import ordered

SCHEMA = "k string, o bigint, v bigint"


def rows(seed, n=400):
    r = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(r.choice(keys), i, r.choice([None, 1, 2, 3])) for i in range(n)]


def grouped(data):
    by = {}
    for k, o, v in sorted(data, key=lambda x: x[1]):
        by.setdefault(k, []).append((o, v))
    return by


def test_lag_matches_plain_order(spark):
    data = rows(1)
    got = ordered.lag_rows(ordered.fragment(spark.createDataFrame(data, SCHEMA), ["k"], ["o"], 5), ["k"], ["o"], F.col("v"), "prev")
    want = {(k, o): (items[i - 1][1] if i else None) for k, items in grouped(data).items() for i, (o, _) in enumerate(items)}
    assert {(x.k, x.o): x.prev for x in got.collect()} == want


def test_rank_matches_plain_order(spark):
    data = rows(2)
    got = ordered.rank_rows(ordered.fragment(spark.createDataFrame(data, SCHEMA), ["k"], ["o"], 5), ["k"], ["o"], "at")
    assert {(x.k, x.o): x["at"] for x in got.collect()} == {(k, o): i for k, items in grouped(data).items() for i, (o, _) in enumerate(items)}


def test_carry_takes_last_value_before(spark):
    data = rows(3)
    got = ordered.carry_rows(ordered.fragment(spark.createDataFrame(data, SCHEMA), ["k"], ["o"], 5), ["k"], ["o"], F.col("v"), "seen")
    want = {}
    for k, items in grouped(data).items():
        last = None
        for o, v in items:
            want[k, o] = last
            last = v if v is not None else last
    assert {(x.k, x.o): x.seen for x in got.collect()} == want


def test_trailing_rows_cross_blocks(spark):
    data = rows(4)
    ranked = ordered.rank_rows(ordered.fragment(spark.createDataFrame(data, SCHEMA), ["k"], ["o"], 5), ["k"], ["o"], "at")
    got = ordered.trailing_rows(ranked, ["k"], "at", F.col("o"), 7, "ctx", block=16)
    want = {(k, o): [x for x, _ in items[max(0, i - 6) : i + 1]] for k, items in grouped(data).items() for i, (o, _) in enumerate(items)}
    assert {(x.k, x.o): x.ctx for x in got.collect()} == want


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0), ("c", None)], "k string, x double")
    got = {r.k: r for r in ordered.group_percentiles(df, ["k"], "x", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (got["a"].n, got["a"]["mean"], got["a"].p50, round(got["a"].p95, 6)) == (10, 4.5, 4.5, 8.55)
    assert (got["b"].n, got["b"].p50) == (1, 5.0)
    assert "c" not in got


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    f = ordered.fragment(empty, ["k"], ["o"])
    assert ordered.lag_rows(f, ["k"], ["o"], F.col("v"), "p").count() == 0
    assert ordered.rank_rows(f, ["k"], ["o"], "p").count() == 0
    assert ordered.group_percentiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
