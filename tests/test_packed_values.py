import random

import pytest
from pyspark.sql import functions as F

from quern.operators import packed_values as p


def split(spark, texts, rounds=3):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id bigint, text string, field string")
    got = p.split_columns([("f", df, F.col("row_id"), F.col("text"))], rounds).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.row_id, r.item_no)):
        out.setdefault(r.row_id, []).append(r.value)
    return [out.get(i, []) for i in range(len(texts))]


CASES = [
    ("A giấy; B giấy", ["A giấy", "B giấy"]),
    ("A giấy;B giấy|C giấy", ["A giấy", "B giấy", "C giấy"]),
    ("- Đơn\n- Thẻ", ["Đơn", "Thẻ"]),
    ("1. Đơn 2. Thẻ 3. Ảnh", ["Đơn", "Thẻ", "Ảnh"]),
    ("(1) Đơn; (2) Thẻ", ["Đơn", "Thẻ"]),
    ("Đơn ;  ; Thẻ ;", ["Đơn", "Thẻ"]),
    ("Bản dịch Việt/Anh / Ảnh thẻ 3x4", ["Bản dịch Việt/Anh", "Ảnh thẻ 3x4"]),
    ("Phiếu điểm từ 6,5 trở lên, Đơn", ["Phiếu điểm từ 6,5 trở lên", "Đơn"]),
    ('"Mẫu ""C; D"" của khoa"; Đơn', ['Mẫu "C; D" của khoa', "Đơn"]),
    ("«Quầy, ca sáng» | “a; b”", ["Quầy, ca sáng", "a; b"]),
    ("Ảnh (nền trắng, mới chụp)", ["Ảnh (nền trắng, mới chụp)"]),
    ("https://x.example/d?ca=1,2, Cổng", ["https://x.example/d?ca=1,2", "Cổng"]),
    ("https://x.example/a;Cổng", ["https://x.example/a", "Cổng"]),
    ('["Đơn", "Thẻ, ảnh", null, " "]', ["Đơn", "Thẻ, ảnh"]),
    ("Bằng tốt nghiệp và học bạ", ["Bằng tốt nghiệp và học bạ"]),
    ("Đơn + Thẻ\tẢnh · Sổ • Học bạ", ["Đơn", "Thẻ", "Ảnh", "Sổ", "Học bạ"]),
    ("- Đơn", ["Đơn"]),
    ("Đơn.", ["Đơn"]),
    ("; ; |", []),
    ("(chưa đóng; Đơn", ["(chưa đóng", "Đơn"]),
]


def test_cases(spark):
    assert split(spark, [t for t, _ in CASES]) == [w for _, w in CASES]


def test_nulls_blanks_repeats_and_empty(spark):
    assert split(spark, [None, "", "  ", "a; b", "a; b"]) == [[], [], [], ["a", "b"], ["a", "b"]]
    assert split(spark, []) == []
    twice = spark.createDataFrame([(1, "a; b"), (1, "a; b")], "row_id bigint, text string")
    assert p.split_columns([("f", twice, F.col("row_id"), F.col("text"))]).count() == 2


def test_very_long_text(spark):
    assert split(spark, ["; ".join(f"giấy {i}" for i in range(1500))])[0][-1] == "giấy 1499"


def test_a_value_that_the_column_knows_whole_stays_uncut(spark):
    texts = ["Khoa / Phòng"] * 60 + ["Khoa / Phòng; Đơn"] * 5 + [f"{a}; {b}" for a in ("Đơn", "Thẻ", "Sổ") for b in ("Ảnh", "Bản", "Học bạ")] * 9
    got = split(spark, texts)
    assert got[0] == ["Khoa / Phòng"] and got[60] == ["Khoa / Phòng", "Đơn"] and got[65] == ["Đơn", "Ảnh"]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_and_forward_backward_match_brute_force(seed):
    r = random.Random(seed)
    n = r.randint(1, 6)
    spans = [(i, j, r.uniform(0.01, 1)) for i in range(n) for j in range(i + 1, min(n, i + 4) + 1)]
    weight = {(i, j): w for i, j, w in spans}

    def cuttings(i):
        if i == n:
            yield []
        for j in range(i + 1, n + 1):
            if (i, j) in weight:
                for rest in cuttings(j):
                    yield [(i, j), *rest]

    def prob(c):
        x = 1.0
        for s in c:
            x *= weight[s]
        return x

    every = list(cuttings(0))
    assert p.best_cutting(n, spans) == max(every, key=prob)
    total = sum(map(prob, every))
    want = [sum(prob(c) for c in every if (i, j) in c) / total for i, j, _ in spans]
    assert all(abs(a - b) < 1e-9 for a, b in zip(p.expected_counts(n, spans), want))


def test_places_in_a_run_where_values_may_end():
    assert p.spans_of(3, []) == [(0, 1), (1, 2), (2, 3)]
    assert p.spans_of(4, [(0, 5), (1, 5)]) == [(0, 1), (0, 3), (1, 2), (2, 3), (3, 4)]
    assert p.spans_of(4, [(0, 5), (1, 2), (2, 5)]) == [(0, 1), (0, 2), (0, 4), (1, 2), (2, 3), (2, 4), (3, 4)]
    assert len(p.spans_of(2000, [(k, 2) for k in range(1999)])) == 2001


def test_a_value_of_any_number_of_pieces_stays_uncut_if_the_column_knows_it(spark):
    whole = "Khoa / Phòng / Ban / Tổ / Nhóm / Đội / Quầy"
    texts = [whole] * 60 + [f"{whole}; Đơn"] * 5 + [f"Thẻ; {whole}"] * 5 + [f"{a}; {b}" for a in ("Đơn", "Thẻ", "Sổ") for b in ("Ảnh", "Bản", "Học bạ")] * 9
    got = split(spark, texts)
    assert got[0] == [whole] and got[60] == [whole, "Đơn"] and got[65] == ["Thẻ", whole] and got[70] == ["Đơn", "Ảnh"]


def test_copies_of_one_text_tell_of_no_whole_value(spark):
    texts = ["Phiếu 17 / Sổ 99"] * 40 + ["phiếu 17  /  Sổ 99"] * 3 + ["Đơn; Thẻ"] * 40 + ["Thẻ; Ảnh"] * 40
    got = split(spark, texts)
    assert got[0] == ["Phiếu 17", "Sổ 99"] and got[-1] == ["Thẻ", "Ảnh"]


def test_keys_join_spellings_of_one_value():
    import unicodedata

    assert len({p.value_key("f", v) for v in ("Học bạ", "học  bạ", unicodedata.normalize("NFD", "Học bạ"), "Học\u200b bạ")}) == 1
    assert len(p.value_key("f", "x")) == 16 and p.value_key("f", "x") != p.value_key("g", "x")
