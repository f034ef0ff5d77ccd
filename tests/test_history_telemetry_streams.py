import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import external, history, telemetry
from quern.streaming import views

T0 = dt.datetime(2024, 1, 1)
M = "id bigint, conversation_id bigint, role string, content string, sources string, rating int, created_at timestamp_ntz"


def messages(spark, rows):
    return spark.createDataFrame([(i, c, role, "x", src, rating, T0 + dt.timedelta(seconds=at)) for i, c, role, src, rating, at in rows], M)


def test_look_back_in_one_hot_conversation(spark):
    r = random.Random(1)
    rows = [(i, 1 if i % 3 else 2, r.choice(["user", "assistant", "system"]), "[]", r.choice([None, 1]), i) for i in range(300)]
    got = {x.message_id: x.user_message_id for x in history.preceding_user_message(messages(spark, rows), F.col("rating").isNotNull()).collect()}
    want, last = {}, {}
    for i, c, role, _, rating, _ in rows:
        if role == "user":
            last[c] = i
        if role == "assistant" and rating is not None:
            want[i] = last.get(c)
    assert got == want


def test_segments_and_titles(spark):
    rows = [
        (1, 1, "user", "[]", None, 1), (2, 1, "assistant", '["A", "RAG_DOMAIN:x", "RAG_CONTENT:{}"]', None, 2), (3, 1, "user", "[]", None, 3), (4, 1, "assistant", '["B", "B", "RAG_DOMAIN:y"]', None, 4), (5, 1, "user", "[]", None, 5),
        (6, 2, "assistant", '["C"]', None, 1), (7, 2, "assistant", "['RAG_ROUTE:none']", None, 2), (8, 2, "user", "[]", None, 3),
    ]
    df = messages(spark, rows)
    assert sorted(x.id for x in history.domain_segment(df, F.lit("y"), "d").collect()) == [3, 4, 5, 8]
    more = messages(spark, [*rows, (9, 3, "assistant", '["A", "A", " ", "RAG_CONTENT:{}"]', None, 1), (10, 3, "assistant", "[]", None, 2), (11, 4, "assistant", '["E"]', None, 1), (12, 5, "assistant", '["F", "RAG_CONTENT:{}", "RAG_DOMAIN:d"]', None, 1), (13, 5, "assistant", '["RAG_ROUTE:none"]', None, 2)])
    got = {x.conversation_id: (x.message_id, x.titles) for x in history.active_titles(more, F.lit("d"), "d", F.lit("old")).collect()}
    assert got == {1: (None, []), 2: (None, []), 3: (9, ["A"]), 4: (None, ["old"]), 5: (None, [])}
    other = {x.conversation_id: x.titles for x in history.active_titles(more, F.lit("x"), "d", F.lit("old")).collect()}
    assert other == {1: [], 2: [], 3: [], 4: [], 5: []}
    tail = history.history_tail(df, 3).filter("conversation_id = 1").orderBy("turn").collect()
    assert [(x.turn, x.id) for x in tail] == [(1, 3), (2, 4), (3, 5)]


def test_states_feedback_and_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, o int, v string")
    assert sorted(tuple(r) for r in history.latest_state(df, "k", ["o"], ["v"]).collect()) == [(1, "b"), (2, None)]
    assert [r.k for r in history.append_missing(df, spark.createDataFrame([(2,), (3,), (3,)], "k int"), "k").collect()] == [3]
    rated = spark.createDataFrame([(1, 1), (2, 0), (3, 3)], "id int, rating int")
    assert sorted((r.sink, r.id) for r in history.feedback_routes(rated).collect()) == [("all", 1), ("all", 2), ("all", 3), ("negative", 2), ("positive", 1)]
    history.write_feedback(rated, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 5


def test_rollups_pairs_and_baselines(spark):
    checks = spark.createDataFrame([("a", "x", "PASS"), ("a", "x", "REVIEW"), ("a", "y", "FAIL"), ("b", "x", "PASS")], "k string, alt string, status string")
    assert sorted(tuple(r) for r in telemetry.roll_up(checks, ["k"]).collect()) == [("a", "FAIL"), ("b", "PASS")]
    assert sorted(tuple(r) for r in telemetry.best_alternative(checks, ["k"], "alt").collect()) == [("a", "x", "REVIEW"), ("b", "x", "PASS")]
    pairs = spark.createDataFrame([(1, "on", 5.0), (1, "off", 3.0)], "k int, v string, x double")
    assert telemetry.paired_difference(pairs, ["k"], "v", "x", "on", "off").first().difference == 2.0
    with pytest.raises(Exception, match="incomplete"):
        telemetry.paired_difference(pairs.filter("v = 'on'"), ["k"], "v", "x", "on", "off").collect()
    cur, base = spark.createDataFrame([("s", 11.5), ("t", 1.0)], "suite string, mean double"), spark.createDataFrame([("s", 10.0)], "suite string, mean double")
    got = {r.suite: (r.review, r.change_percent and round(r.change_percent, 6)) for r in telemetry.against_baseline(cur, base, "suite").collect()}
    assert got == {"s": (True, 15.0), "t": (False, None)}


def test_context_and_warm_up(spark):
    df = spark.createDataFrame([("a", i, f"l{i}") for i in range(100)] + [("b", 1, "x")], "k string, o int, line string")
    got = {(r.k, r.o): r.context for r in telemetry.trailing_context(df, ["k"], ["o"], "line").collect()}
    assert got["a", 99] == [f"l{i}" for i in range(40, 100)] and got["b", 1] == ["x"] and got["a", 0] == ["l0"]
    assert telemetry.after_warm_up(df, ["k"], ["o"]).count() == 99
    turns = df.withColumn("bad", F.col("o") == 5)
    assert telemetry.broken_context(turns, ["k"], "o", F.col("bad")).filter("after_failure").count() == 94


def test_urls(spark):
    cases = {
        "https://a.example/x": True, "http://b.a.example:8080": True, "https://a.example.": True, "HTTPS://A.EXAMPLE?q": True, "https://evila.example": False, "https://a.example.evil.example": False,
        "https://user@a.example/": False, "ftp://a.example": False, "https://a.example/\n": False, "https://a.example\\@evil.example": False, "": False, "https://" + "x" * 5000 + ".a.example": False,
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "u string")
    got = {r.u: r.ok for r in df.select("u", external.allowed(F.col("u"), ["a.example"]).alias("ok")).collect()}
    assert got == {**cases, None: False}


def test_external_results_and_claims(spark):
    rows = [("r", 1, "https://a.example/1", "t", "s"), ("r", 2, "https://a.example/1", "u", "s"), ("r", 3, "https://x.example", "t", "s"), ("r", 4, "https://a.example/2", None, " "), ("r", 5, "https://a.example/3", None, "s" * 3000), ("r", 6, "https://a.example/4", "t", "s")]
    got = external.clean_results(spark.createDataFrame(rows, "request_id string, position int, url string, title string, snippet string"), ["a.example"], 2).orderBy("no").collect()
    assert [(r.no, r.url, len(r.snippet)) for r in got] == [(1, "https://a.example/1", 1), (2, "https://a.example/3", 2500)]
    claims = spark.createDataFrame([(1, [0, 1], ["https://a.example", "https://a.example/b"]), (2, [0, 1], ["https://a.example", "https://x.example"]), (3, [5], ["https://a.example"]), (4, [], [])], "claim_id int, cited array<int>, urls array<string>")
    assert sorted((r.claim_id, r.source_no) for r in external.grounded_support(claims, ["a.example"]).collect()) == [(1, 1), (1, 2)]
    assert spark.range(1).select(external.site_clause(F.array(F.lit("a"), F.lit("b")))).first()[0] == "site:a OR site:b"
    search = external.search_function(lambda q, n: [(q, f"https://a.example/{i}", "s") for i in range(9)])
    assert search(F.lit("x"), F.lit(3)).count() == 3 and search(F.lit(" "), F.lit(3)).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    events = [("r1", 1, "start", None), ("r1", 2, "chunk", "Xin "), ("r2", 1, "start", None), ("r1", 3, "chunk", "chào"), ("r1", 4, "end", None), ("r2", 2, "error", "e"), ("r2", 3, "end", None), ("r3", 1, "start", None)]
    df = spark.createDataFrame(events, "request_id string, seq int, event string, text string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = views.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    out = spark.read.schema("request_id string, status string, answer string").parquet(views.run_to_table(views.turn_status(stream), str(tmp_path)))
    assert sorted(tuple(r) for r in out.collect()) == [("r1", "ok", "Xin chào"), ("r2", "error", "")]
    assert sorted(tuple(r) for r in views.turn_status_batch(df).collect()) == [("r1", "ok", "Xin chào"), ("r2", "error", ""), ("r3", "incomplete", "")]


def test_stream_of_days_and_windows(spark, tmp_path):
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=9 * i), "a") for i in range(20)], "created_at timestamp_ntz, k string")
    df.write.parquet(str(tmp_path / "in"))
    stream = views.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema)
    assert sorted(tuple(r) for r in views.run_complete(views.daily_counts(stream)).collect()) == sorted(tuple(r) for r in views.daily_counts(df).collect())
    closed = spark.read.parquet(views.run_to_table(views.windowed_counts(stream, "created_at", "k", "1 day", "1 hour"), str(tmp_path)))
    assert 1 <= closed.count() <= 8 and closed.agg(F.sum("n")).first()[0] <= 20
