import itertools
import json
import random

import pytest

from quern.operators import schema_drift as d
from quern.operators.ordered import once_each

JOBS = "id string, domain string, created_at string, profile string, extra string"
RECORDS = "row_id bigint, job_id string, line_no int, body string, extra string"


def job(i, mapping, domain="d", at=None):
    return (i, domain, at or f"2024-01-0{i[-1]}T00:00:00Z", json.dumps({"schema_mapping": mapping}) if mapping is not None else None, "x")


def changes(spark, jobs, records):
    got = d.schema_changes(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(records, RECORDS))
    return {(r.job_id, r.field_name, r.change_kind) for r in got.collect()}


def test_each_kind_of_change(spark):
    jobs = [job("j1", {"fee": "Phí", "year": "Năm áp dụng", "gone": "Cũ"}), job("j2", {"cost": " phí ", "year": "Niên khóa", "new": "Mới"})]
    records = [(1, "j1", 1, json.dumps({"Phí": 10, "Năm áp dụng": "2024"}), ""), (2, "j2", 1, json.dumps({"PHÍ": "10 đồng", "Niên khóa": "2025", "Mới": [1]}), "")]
    assert changes(spark, jobs, records) == {
        ("j2", "cost", "renamed"), ("j2", "cost", "type_changed"), ("j2", "year", "renamed"), ("j2", "new", "added"), ("j2", "gone", "removed"),
    }


def test_headers_fold_composition_space_and_case(spark):
    jobs = [job("j1", {"a": "Chủ đề"}), job("j2", {"a": " CHỦ   ĐỀ"})]
    assert changes(spark, jobs, []) == set()


def test_order_is_by_instant_then_id_and_unreadable_profiles_are_passed_over(spark):
    jobs = [
        job("j1", {"a": "A"}, at="2024-01-01T07:00:00+07:00"),
        job("j2", None, at="2024-01-01T01:00:00Z"),
        ("j3", "d", "2024-01-01T02:00:00Z", '{"schema_mapping": {"a"', "x"),
        ("j6", "d", "2024-01-01T02:30:00Z", '{"schema_mapping": null}', "x"),
        job("j4", {"a": "A", "b": "B"}, at="2024-01-01T03:00:00.5Z"),
        job("j4", {"a": "A", "b": "B"}, at="2024-01-01T03:00:00.5Z"),
        job("j5", {"b": "B"}, at="2024-01-01T03:00:00.500+00:00"),
        job("o1", {"z": "Z"}, domain="other"),
        (None, "d", "2024-01-01T03:00:00Z", "{}", "x"),
        ("j7", None, "2024-01-01T03:00:00Z", '{"schema_mapping": {}}', "x"),
    ]
    assert changes(spark, jobs, []) == {("j4", "b", "added"), ("j5", "a", "removed")}


def test_kinds_ignore_nulls_and_empty_and_broken_bodies(spark):
    jobs = [job("j1", {"a": "A"}), job("j2", {"a": "A"}), job("j3", {"a": "A"})]
    records = [(1, "j1", 1, '{"A": 1}', ""), (1, "j1", 1, '{"A": 1}', ""), (2, "j2", 1, '{"A": ""}', ""), (3, "j2", 2, '{"A": null}', ""), (4, "j2", 3, "not json", ""), (5, "j3", 1, '{"A": true}', ""), (6, None, 1, '{"A": 1}', ""), (7, "j3", 2, None, "")]
    assert changes(spark, jobs, records) == set()
    assert d.value_kind(True) == "boolean" and d.value_kind(2.5) == "number" and d.value_kind([]) == "list" and d.value_kind("") is None and d.value_kind({}) is None


def test_empty_tables(spark):
    assert changes(spark, [], []) == set()
    none = d.unified_records(spark.createDataFrame([], JOBS), spark.createDataFrame([], RECORDS))
    assert none.count() == 0


def test_unified_names_follow_renames(spark):
    jobs = [job("j1", {"fee": "Phí"}), job("j2", {"cost": "Phí"}), job("j3", {"cost": "Lệ phí", "n": "N"}), job("j4", {"n": "N"})]
    records = [(1, "j1", 1, '{"Phí": 5, "ghi chú": "x"}', ""), (2, "j2", 1, '{"phí": "6"}', ""), (3, "j3", 1, '{"Lệ phí": ["7"], "N": ""}', ""), (4, "nojob", 1, '{"A": 1}', "")]
    got = {r.row_id: r for r in d.unified_records(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(records, RECORDS)).collect()}
    assert got[1].fields == {"fee": "5"} and got[1].extra == {"ghi chú": "x"}
    assert got[2].fields == {"fee": "6"}
    assert got[3].fields == {"fee": '["7"]', "n": None}
    assert got[4].fields == {} and got[4].extra == {"A": "1"}


@pytest.mark.parametrize("seed", range(8))
def test_assignment_is_optimal(seed):
    r = random.Random(seed)
    n, m = r.randint(1, 5), r.randint(1, 5)
    w = [[r.randint(0, 9) for _ in range(m)] for _ in range(n)]
    got = d.assign(w)
    assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)
    total = sum(w[i][j] for i, j in enumerate(got) if j >= 0)
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = max(sum(w[i][j] if n <= m else w[j][i] for i, j in zip(small, p)) for p in itertools.permutations(large, len(small)))
    assert total == best


def test_likely_rename_of_key_and_header_is_shown(spark):
    jobs = [job("j1", {"applicable_year": "Năm áp dụng"}), job("j2", {"application_year": "Năm tuyển"})]
    records = [(i, f"j{1 + i % 2}", i, json.dumps({"Năm áp dụng" if i % 2 == 0 else "Năm tuyển": str(2020 + i // 2 % 3)}), "") for i in range(12)]
    got = d.schema_changes(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(records, RECORDS)).filter("change_kind = 'added'").first()
    assert got.old_value == "applicable_year: Năm áp dụng"


def test_columns_that_first_had_one_key_stay_apart(spark):
    jobs = [job("j1", {"a": "Fee"}), job("j2", {"b": "Fee"}), job("j3", {"b": "Fee", "a": "Name"}), job("j4", {"a": "Name", "b": "Fee"})]
    records = [(i, f"j{j}", 1, body, "") for i, (j, body) in enumerate([(1, '{"Fee": 10}'), (2, '{"fee": 20}'), (3, '{"Fee": 30, "Name": "X"}'), (4, '{"Name": "Y", "Fee": 40}')], 1)]
    got = {r.row_id: r.fields for r in d.unified_records(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(records, RECORDS)).collect()}
    assert got == {1: {"a": "10"}, 2: {"a": "20"}, 3: {"a": "30", "a@j3": "X"}, 4: {"a": "40", "a@j3": "Y"}}


def test_no_value_of_a_record_is_lost():
    body = '{"Fee": 1, "fee": 2, "Fee": 3, "x": {"y": 1, "y": 2}, "x": [4], "n": null}'
    assert d.unify(body, {"fee": "f"}) == ({"f": "1"}, {"fee": "2", "Fee": "3", "x": '{"y": 2}', "x (2)": "[4]", "n": None})
    assert d.unify("[1]", {}) == d.unify(None, {}) == d.unify("{", {}) == ({}, {})


def test_once_each_is_drop_duplicates(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c"), (3, "d")], "k bigint, v string")
    assert sorted(map(tuple, once_each(rows, "k").collect()), key=str) == sorted(map(tuple, rows.dropDuplicates(["k"]).collect()), key=str)


def test_recall_of_likely_renames_on_planted_columns():
    import numpy as np
    import xxhash

    r = random.Random(5)
    words = "applicable application year fee school channel paper service counter time limit topic content form code station".split()

    def column(name, values):
        hashes = np.array([xxhash.xxh64_intdigest(v) for v in values], dtype=np.uint64)
        sketch = d.sketch_values(np.zeros(len(values), dtype=np.int64), hashes, 1)[0]
        return {"key": "_".join(name), "header": " ".join(name), "raw": " ".join(name).title(), "kind": "text", "sketch": [int(x) for x in sketch]}

    planted = found = wrong = 0
    for _ in range(60):
        names = [tuple(r.sample(words, 3)) for _ in range(8)]
        vocabulary = [[f"{i} {r.random()}" for _ in range(30)] for i in range(8)]
        old = [column(n, r.sample(v, 25)) for n, v in zip(names, vocabulary)]
        new_names = [(*n[:2], n[2] + "s") if r.random() < 0.5 else (n[1], r.choice(words) + "x", n[2] + "y") for n in names[:6]]
        new = [column(n, r.sample(v, 25)) for n, v in zip(new_names, vocabulary)] + [column((f"other{k}", "thing", "z"), [f"q{r.random()}" for _ in range(25)]) for k in range(2)]
        want = {n["key"]: o["key"] for n, o in zip(new[:6], old)}
        got = {x[3]: x[5].split(":")[0] for x in d.compare_jobs("d", "a", "b", old, new, 0.35) if x[4] == "added" and x[5]}
        planted += len(want)
        found += sum(got.get(k) == v for k, v in want.items())
        wrong += sum(want.get(k) != v for k, v in got.items())
    assert found / planted >= 0.9 and wrong <= 0.05 * planted
