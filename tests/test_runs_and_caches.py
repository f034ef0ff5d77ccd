import datetime as dt
import json
import os
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, external, retrieval, selection
from quern.sources import runs
from quern.streaming import views

T0 = dt.datetime(2024, 1, 1)


def hits(requests, ttl):
    """Brute force: requests of a key in order; a miss stores an answer."""
    out, stored = {}, {}
    for key, rid, at in sorted(requests, key=lambda r: (r[2], r[1])):
        ms = int((at - T0).total_seconds() * 1000)
        out[rid] = key in stored and ms - stored[key] <= ttl
        if not out[rid]:
            stored[key] = ms
    return out


def test_answer_cache_matches_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"k{r.randint(0, 5) if i % 3 else 0}", i, T0 + dt.timedelta(seconds=r.randint(0, 5000))) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, request_id bigint, at timestamp")
    want = hits(rows, 60_000)
    assert {x.request_id: x.hit for x in views.answer_cache_batch(df, 60_000).collect()} == want and 0 < sum(want.values()) < 600
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = views.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema).withWatermark("at", "1 minute")
    got = spark.read.parquet(views.run_to_table(views.answer_cache(stream, 60_000), str(tmp_path / "out")))
    assert {x.request_id: x.hit for x in got.collect()} == want


def test_merged_turns(spark):
    rows = [("a", 1, "user", "q"), ("a", 3, "chunk", "y"), ("a", 2, "chunk", "x"), ("a", 4, "route", "d1"), ("a", 5, "route", "d2"), ("a", 6, "end", None), ("b", 1, "user", "q"), ("c", 1, "cancelled", None), ("c", 2, "end", None), ("d", 1, "error", "e"), ("d", 2, "state", "s")]
    got = {r.request_id: tuple(r)[1:] for r in views.merged_turns(spark.createDataFrame(rows, "request_id string, seq int, event string, text string")).collect()}
    assert got == {"a": ("q", "xy", "d2", None, "ok"), "b": ("q", "", None, None, "incomplete"), "c": (None, "", None, None, "cancelled"), "d": (None, "", None, "s", "error")}


def test_uploads_jobs_and_bundles(spark, tmp_path):
    f = tmp_path / "A.CSV"
    f.write_text("a,b\n1,2\n")
    one, two = (runs.store_upload(str(f), str(tmp_path / "up")) for _ in range(2))
    assert one == two and one.endswith(".csv") and os.listdir(tmp_path / "up") == [os.path.basename(one)]
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    for name, job in {"a": {"id": "a", "status": "running", "pid": 7, "created_at": "1"}, "b": {"id": "b", "status": "succeeded", "created_at": "2"}, "c": {"id": "c", "status": "queued", "pid": 8, "created_at": "3"}}.items():
        (jobs / f"{name}.json").write_text(json.dumps(job))
    (jobs / "x.json").write_text("{")
    got = runs.list_jobs(str(jobs), lambda pid: pid == 8, lambda: "now")
    assert [(j["id"], j["status"]) for j in got] == [("c", "queued"), ("b", "succeeded"), ("a", "failed")]
    assert json.loads((jobs / "a.json").read_text())["updated_at"] == "now"
    bundle = runs.write_bundle(str(tmp_path / "run"), {"results": spark.range(3)}, {"suite": "x"})
    assert json.loads(open(os.path.join(bundle, "summary.json")).read()) == {"suite": "x", "rows": {"results": 3}}
    assert runs.new_bundles(["a"], ["b", "a"]) == ["b"]
    assert runs.sql_frame(spark, "select 1 as a").first()[0] == 1
    with pytest.raises(Exception):
        runs.sql_frame(spark, "select nothing from nowhere").collect()


def test_logs_recent_tailed_and_zipped(spark, tmp_path):
    logs = tmp_path / "logs"
    (logs / "20240101T000000_000001Z").mkdir(parents=True)
    (logs / "20240101T000000_000001Z" / "new.log").write_text("TIMING {}\n")
    old = logs / "old.log"
    old.write_text("x\n")
    os.utime(old, (0, 0))
    assert [r.value for r in spark.read.options(**runs.recent_files(str(logs))).text(str(logs)).collect()] == ["TIMING {}"]
    df = spark.createDataFrame([("a" * 20,), ("b",), (None,)], "t string")
    assert [r.t for r in runs.log_tail(df, "t", 3).collect()] == ["aaa", "b", None]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("l/a.log", "one\ntwo\n")
        z.writestr("b.txt", "no\n")
    assert [(r.member, r.no, r.value) for r in runs.zip_lines(spark, str(tmp_path / "z.zip")).orderBy("no").collect()] == [("l/a.log", 1, "one"), ("l/a.log", 2, "two")]
    assert runs.head(spark.range(10), ["id"], 2).count() == 2
    names = spark.createDataFrame([("20240102T030405_000007Z",), ("x",)], "n string").select(runs.session_time(F.col("n")).alias("t"))
    assert [None if r.t is None else r.t.microsecond for r in names.collect()] == [7, None]


def test_events_are_appended_and_streamed_without_loss(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x") for i in range(5)], "id bigint, event string")
    runs.append_events(rows, str(tmp_path / "e"))
    runs.append_events(rows, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 10
    stream = spark.readStream.schema(rows.schema).json(str(tmp_path / "e"))
    runs.event_sink(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.json(str(tmp_path / "s")).count() == 10


def test_injected_models_spans_and_revisions(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab"), (2, " "), (3, None), (4, "c")], "id bigint, text string")
    assert {r.id: r.embedding for r in runs.embed(df, lambda xs: [[len(x), 1.0] for x in xs], 2, 1).collect()} == {1: [2.0, 1.0], 4: [1.0, 1.0]}
    with pytest.raises(Exception, match="another number"):
        runs.embed(df, lambda xs: [], 2).collect()
    prompts = df.select("id", F.col("text").alias("prompt"))
    assert {r.id: r.reply for r in runs.replies(prompts, lambda p: p.upper() if p.strip() else 1 / 0, "[]").collect()} == {1: "AB", 2: "[]", 3: "[]", 4: "C"}
    said, stages = [], []

    @runs.timed("t", said.append)
    def work(x):
        return 1 / x

    assert work(1) == 1
    with pytest.raises(ZeroDivisionError):
        work(0)
    assert [(e["event"], e.get("status"), e.get("error")) for e in said] == [("start", None, None), ("end", "ok", None), ("start", None, None), ("end", "error", "ZeroDivisionError")]
    assert runs.staged([("a", lambda x: x + 1), ("b", lambda x: x * 2)], 1, stages.append) == 4 and stages == ["a", "b"]
    f = tmp_path / "f"
    f.write_text("1")
    first = runs.revision({"a": 1}, [str(f)], {})
    assert first == runs.revision({"a": 1}, [str(f)], {}) != runs.revision({"a": 2}, [str(f)], {})
    time.sleep(0.01)
    f.write_text("22")
    assert runs.revision({"a": 1}, [str(f)], {}) != first
    assert [r[0] for r in spark.createDataFrame([("0123456789abcdef",), ("x",)], "h string").select(runs.valid_trace(F.col("h"))).collect()] == ["0123456789abcdef", None]


def test_rates_per_unit_read_alike(spark):
    texts = ["Giá 5.000 đồng/ngày", "một ngày là 5.000 đồng", "mỗi tháng 5 đồng", "từng tháng 5 đồng", "một ngày không tính 5.000 đồng", "1 ngày 5.000 đồng mỗi tháng", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", evaluation.per_unit(F.col("t")).alias("w"))
    got = {r.i: r.w for r in df.collect()}
    assert "moi ngay" in got[0] and got[1].endswith(" moi ngay") and got[2] == "moi thang 5 dong" and got[3] == "moi thang 5 dong"
    assert not got[4].endswith("moi ngay") and got[5] == "1 ngay 5.000 dong moi thang"


def test_queries_in_several_blocks_find_the_same(spark, monkeypatch):
    r = random.Random(4)
    data = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vectors = spark.createDataFrame([*data, (None, data[0][1]), (999, None)], "vec_id bigint, embedding array<float>")
    queries = vectors.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = sorted(map(tuple, retrieval.vector_topk(queries, vectors, 5).collect()))
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1500)
    assert sorted(map(tuple, retrieval.vector_topk(queries, vectors, 5).collect())) == want and len(want) == 5 * queries.filter("embedding is not null").count()


def test_a_large_catalogue_of_forms(spark, monkeypatch):
    monkeypatch.setattr(external, "PART", 60_000)
    forms = spark.range(200_000).selectExpr("id as form_no", "concat('form ', id, ' x') as form").unionByName(spark.createDataFrame([(200_000, "học bổng"), (200_001, "học")], "form_no bigint, form string"))
    rows = spark.createDataFrame([(1, "xin học bổng", "form 7 x"), (2, "không", "về form 123456 x và form 99 x"), (3, None, None), (4, "gì", "")], "row_id bigint, title string, question string")
    got = {r.row_id: (r.form_no, r.matched_by) for r in external.match_forms(rows, forms).collect()}
    assert got == {1: (200_000, "title"), 2: (99, "question")}


def test_replies_with_defects_have_defined_results(spark):
    bad = ["[1]", "x", None, '["a", "z"]', "```json\n[\"a\"]\n```", "[]"]
    df = spark.createDataFrame(list(enumerate(bad)), "i int, r string")
    got = {r.i: r.f for r in df.select("i", selection.selected_fields(F.array(F.lit("b")), F.col("r"), ["a", "b", "content"]).alias("f")).collect()}
    every = ["a", "b", "content"]
    assert got == {0: every, 1: every, 2: every, 3: every, 4: ["b", "a", "content"], 5: ["b", "content"]}


def workbook(path, rows, shared=("Mã", "Tên dịch vụ", "00123", "NA")):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Một" sheetId="1" r:id="r1"/><sheet name="Hai" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{x[:1]}</t></r><r><t>{x[1:]}</t></r></si>" for x in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {main}><sheetData><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')


def test_a_sheet_of_a_workbook(spark, tmp_path):
    from quern.operators.ingest import IngestError
    from quern.sources.tables import read_upload

    path = str(tmp_path / "a.xlsx")
    workbook(path, '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="str"><v>D</v></c></row>'
             '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" t="s"><v>3</v></c><c r="C2"><v>5</v></c><c r="D2" s="1"><v>45292</v></c></row>'
             '<row r="4"><c r="B4"><v>1.5</v></c><c r="C4" t="b"><v>1</v></c><c r="D4" s="2"><v>45292.5</v></c></row>')
    got = read_upload(spark, path)
    assert got.columns == ["Mã", "Tên dịch vụ", "Unnamed: 2", "D", "position"]
    assert [tuple(r) for r in got.orderBy("position").collect()] == [("00123", "NA", "5", "2024-01-01T00:00:00", 2), ("", "1.5", "True", "2024-01-01T12:00:00", 4)]
    assert read_upload(spark, path, "Hai").columns == ["x", "position"] and read_upload(spark, path, 1).count() == 0
    with pytest.raises(Exception, match="no sheet"):
        read_upload(spark, path, "Ba").collect()
    assert issubclass(IngestError, ValueError)


def test_positions_are_counted_in_each_file(spark, tmp_path):
    from quern.sources.tables import read_upload

    (tmp_path / "d.csv").mkdir()
    for n in "ab":
        (tmp_path / "d.csv" / f"{n}.csv").write_text("x,y\n" + "".join(f'{n}{i},"q\nr"\n' for i in range(50)))
    got = {r.x: r.position for r in read_upload(spark, str(tmp_path / "d.csv")).collect()}
    assert got == {f"{n}{i}": i + 2 for n in "ab" for i in range(50)}


def test_a_lock_of_a_writer_that_is_gone_is_taken_over(spark, tmp_path):
    from quern.operators.ingest import IngestError
    from quern.sources.snapshots import Snapshots

    s = Snapshots(str(tmp_path / "d"))
    with s.lock():
        with pytest.raises(IngestError):
            with s.lock():
                pass
    assert s.files.names() == []
    s.files.create("writer.lock")
    time.sleep(0.05)
    with Snapshots(str(tmp_path / "d"), stale_s=0.01).lock():
        pass
    s.files.write_json("a.json", {"x": 1})
    s.files.write_json("a.json", {"x": 2})
    assert s.files.read_json("a.json") == {"x": 2} and s.files.read_json("b.json") is None


def test_nearest_titles_match_brute_force(spark):
    import difflib

    titles = ["Hoc bong A", "hoc-bong", "Học bổng", "Lịch thi", "hocbongx", "x", None]
    rows = spark.createDataFrame([("s", t) for t in titles] + [("r", "gì")], "school string, title string")
    got = evaluation.nearest_titles(rows, spark.createDataFrame([("s", "Hoc bong"), ("q", "y")], "school string, target string"), "school", "title").orderBy("no").collect()
    plain = {"Hoc bong A": "hocbonga", "hoc-bong": "hocbong", "Học bổng": "hocbong", "Lịch thi": "lichthi", "hocbongx": "hocbongx", "x": "x"}
    want = sorted(plain, key=lambda t: (difflib.SequenceMatcher(None, "hocbong", plain[t]).ratio(), t), reverse=True)[:3]
    assert [r.title for r in got] == want and {r.school for r in got} == {"s"}
