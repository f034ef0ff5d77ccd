import json
import os

import pytest

from quern.operators import ingest
from quern.sources import profiles, snapshots, tables

MAP = {"code": "Mã", "name": "Tên dịch vụ"}


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_csv_keeps_text_as_it_is(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿Mã,Tên dịch vụ,\n00123,NA,\n"x\ny","a ""b"", c",z\n,,\n')
    got = tables.read_upload(spark, path).orderBy("position").collect()
    assert [tuple(r) for r in got] == [("00123", "NA", "", 2), ("x\ny", 'a "b", c', "z", 3), ("", "", "", 4)]
    assert tables.read_upload(spark, path).columns == ["Mã", "Tên dịch vụ", "Unnamed: 2", "position"]


def test_tsv_json_and_jsonl(spark, tmp_path):
    assert tables.read_upload(spark, write(tmp_path, "a.tsv", "A\tB\n1,5\t2\n")).collect() == [("1,5", "2", 2)]
    assert sorted(tuple(r) for r in tables.read_upload(spark, write(tmp_path, "a.json", '[{"A": 1, "B": "x"}, {"A": null, "B": "y"}]')).collect()) == [("", "y", 3), ("1", "x", 2)]
    assert sorted(tuple(r) for r in tables.read_upload(spark, write(tmp_path, "a.jsonl", '{"A": "007"}\n\n{"A": "b"}\n')).collect()) == [("007", 2), ("b", 3)]


def test_refused_files(spark, tmp_path):
    for name, text in (("n.json", '[{"A": {"x": 1}}]'), ("e.json", "[]"), ("x.pdf", ""), ("d.csv", "A,A\n1,2\n")):
        with pytest.raises(ingest.IngestError):
            tables.read_upload(spark, write(tmp_path, name, text))


def source(spark, rows):
    return spark.createDataFrame(rows, "`MÃ` string, `tên  dịch vụ` string, note string, `Unnamed: 3` string, position bigint")


def test_prepare_skips_and_reports(spark):
    df = source(spark, [("1", " A ", "n", "", 2), ("", "", "", "", 3), ("2", "", "x", None, 4), ("1", "A", "n", "", 5), (None, "C", None, "", 6)])
    records, report, skipped = ingest.prepare(df, MAP, "name", "position")
    got = {r.name: r for r in records.collect()}
    assert sorted(r.record_id.split(":")[1] for r in records.collect() if r.name == "A") == ["1", "2"]
    assert json.loads(got["C"].raw_json) == {"MÃ": "", "tên  dịch vụ": "C", "note": ""}
    r = report.first()
    assert (r.input_rows, r.indexed_rows, r.empty_rows, r.missing_primary, r.unmapped_columns) == (5, 3, 1, 1, ["note"])
    assert [x.position for x in skipped.collect()] == [4]


def test_ids_survive_reordering(spark):
    rows = [("1", "A", "n", "", 2), ("2", "B", "n", "", 3), ("1", "A", "n", "", 4)]
    ids = lambda data: {r.record_id for r in ingest.prepare(source(spark, data), MAP, "name", "position")[0].collect()}
    assert ids(rows) == ids([("2", "B", "n", "", 2), ("1", "A", "n", "", 3), ("1", "A", "n", "", 4)])


def test_whole_load_rules(spark):
    good = [("1", "A", "n", "", 2), ("2", "B", "n", "", 3)]
    records, _, _ = ingest.prepare(source(spark, good), MAP, "name", "position", "code")
    assert {r.record_id for r in records.collect()} == {"1", "2"}
    for rows, mapping, key in (([("1", "A", "", "", 2), ("1", "B", "", "", 3)], MAP, "code"), ([("", "A", "", "", 2)], MAP, "code"), ([("1", "", "x", "", 2)], MAP, None), (good, {**MAP, "z": "Z"}, None), (good, {"record_id": "Mã", "name": "Tên dịch vụ"}, None)):
        with pytest.raises(ingest.IngestError):
            ingest.prepare(source(spark, rows), mapping, "name", "position", key)
    twice = spark.createDataFrame([("a", "b", 2)], "A string, ` a` string, position bigint")
    with pytest.raises(ingest.IngestError):
        ingest.prepare(twice, {"name": "A"}, "name", "position")


def test_multiset_difference(spark):
    a = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "k string, v int")
    b = spark.createDataFrame([("x", None), ("z", 1), ("y", 1)], "k string, v int")
    assert sorted((r.k, r.side, r.extra) for r in ingest.multiset_difference(a, b).collect()) == [("x", "left", 1), ("z", "right", 1)]
    assert ingest.multiset_difference(a, a).count() == 0


def test_publish_rollback_and_failures(spark, tmp_path):
    snap = snapshots.Snapshots(str(tmp_path / "d"))
    records = spark.createDataFrame([("a", "A"), ("b", "B")], "record_id string, name string")
    first = snap.publish(records, {"indexed_rows": 2}, {"p": 1})
    assert snap.active() == first and snap.read(spark).count() == 2
    with pytest.raises(ingest.IngestError):
        snap.publish(records, {"indexed_rows": 3}, {})
    with pytest.raises(ingest.IngestError):
        snap.publish(records, {"indexed_rows": 2}, {}, lambda r: r.select("record_id").filter("record_id = 'a'"))
    assert snap.active() == first and snap.generations() == [first]
    second = snap.publish(records, {"indexed_rows": 2}, {"p": 2})
    assert snap.active() == second and set(snap.generations()) == {first, second}
    snap.rollback(first)
    assert snap.active() == first
    with pytest.raises(ingest.IngestError):
        snap.rollback("0" * 32)
    with snap.lock(), pytest.raises(ingest.IngestError):
        snap.publish(records, {"indexed_rows": 2}, {})
    with pytest.raises(ValueError):
        snapshots.write_json(str(tmp_path / "x.json"), {"a": float("nan")})
    assert not os.path.exists(tmp_path / "x.json")


def test_archive(spark, tmp_path):
    (tmp_path / "d").mkdir()
    target = snapshots.archive(str(tmp_path / "d"), str(tmp_path / "old"))
    assert not (tmp_path / "d").exists() and json.load(open(os.path.join(target, "manifest.json")))["moved_from"].endswith("/d")


GOOD = {"domain_name": "d", "schema_mapping": {"name": "Tên", "email": "Thư"}, "primary_entity": "name"}


@pytest.mark.parametrize(
    "change",
    [{"schema_mapping": {}}, {"schema_mapping": {"id": "X", "name": "Y"}}, {"schema_mapping": {"name": "A", "b": " a"}}, {"primary_entity": "zz"}, {"source_id_field": "zz"}, {"excluded_fields": ["zz"]}, {"excluded_fields": ["name"]}, {"candidate_k": 0}, {"candidate_k": 201}, {"result_k": 30}, {"minimum_score": 2}, {"candidate_k": True}],
)
def test_profile_faults(change):
    with pytest.raises(ingest.IngestError):
        profiles.validate({**GOOD, **change})


def test_profiles_overlays_and_lifecycle(spark, tmp_path):
    p = profiles.validate({**GOOD, "candidate_k": "30"})
    assert p.public == ["name"] and profiles.validate({**GOOD, "excluded_fields": []}).public == ["name", "email"]
    assert profiles.overlay(GOOD, {"result_k": 3}, {"result_k": 4})["result_k"] == 4
    with pytest.raises(ingest.IngestError):
        profiles.overlay(GOOD, {"primary_entity": "email"})
    reg = profiles.Registry(str(tmp_path))
    reg.snapshots("d").publish(spark.createDataFrame([("a",)], "record_id string"), {"indexed_rows": 1}, GOOD)
    reg.snapshots("e")
    assert reg.names() == ["d", "default", "e"] and reg.ready() == ["d"]
    reg.set_state("d", "disabled")
    assert reg.state("d") == "disabled" and reg.ready() == []
    reg.snapshots("default")
    with pytest.raises(ingest.IngestError):
        reg.set_state("default", "deleted")


def test_logs_feedback_and_frames(spark, tmp_path):
    log = write(tmp_path, "a.log", 'x TIMING {"request_id": "r", "task": "t", "elapsed_ms": 5, "extra": 1}\nnoise\n{"request_id": "s", "event": "end"}\n{broken\n')
    assert sorted((r.request_id, r.task, r.elapsed_ms) for r in tables.read_events(spark, log).collect()) == [("r", "t", 5.0), ("s", None, None)]
    fb = write(tmp_path, "f.jsonl", '{"rating": 1, "input": "a", "rag_context": []}\n{oops\n')
    assert [r.rating for r in tables.read_feedback(spark, fb).collect()] == [1]
    lines = [("s", 1, 'data: {"content": "Xin "}'), ("s", 3, "data: [DONE]"), ("s", 2, 'data: {"content": "chào"}'), ("s", 0, 'data: {"metadata": {"domain": "d"}}'), ("t", 1, "data: oops"), ("t", 2, ": ping")]
    got = {r.stream_id: r for r in tables.read_frames(spark, spark.createDataFrame(lines, "stream_id string, seq int, line string")).collect()}
    assert (got["s"].answer, got["s"].done, got["s"].errors, json.loads(got["s"].metadata)) == ("Xin chào", True, [], {"domain": "d"})
    assert (got["t"].done, got["t"].errors) == (False, ["oops"])
    write(tmp_path, "j.json", '{"id": 1}')
    assert {"id": 1} in tables.read_json_records(str(tmp_path)) and tables.read_json_records(str(tmp_path / "none")) == []
