import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import personal_info as p
from quern.llm.visual_forms import text_rows

BITS = {w: 9.0 for w in "kiều văn đoan nguyễn diệu maren astermoor".split()} | {"thị": 4.0}
CASES = [
    ("Email của em là a.b+c@thu.sinhvien.example.", {"email"}), ("gửi x_y (at) lop(dot)example(dot)net giúp", {"email"}), ("van_b6 [a còng] hopthu chấm example; nhé", {"email"}), ("x9 @ hopthu.example!", {"email"}),
    ("Nhóm @k26 cũng hỏi. Xin chào", set()), ("qua cong sinh vien", set()),
    ("gọi 0951 501 693.", {"phone"}), ("Zalo (+84) 954-729-273", {"phone"}), ("số 84 958507485", {"phone"}), ("0084 954 415 519", {"phone"}), ("Call +1 (202) 555-0110!", {"phone"}), ("202-555-0112", {"phone"}),
    ("mã vạch 8931651494235", set()), ("Hồ sơ HS-2022-912166", set()), ("phí 14.400.000 đồng", set()), ("máy lẻ 272, phòng B413, ngày 05/09/2025, 08:15", set()), ("mã 7954938", set()),
    ("CCCD 007237236714.", {"id_number"}), ("căn cước số 003 125 949 968", {"id_number"}), ("Em gửi CMND: 391074279", {"id_number"}), ("Hộ chiếu X4301847;", {"id_number"}), ("My ID number is 392389076.", {"id_number"}),
    ("nộp căn cước bản chụp và thẻ", set()),
    ("Số nhà 229, ngõ 10, phố Gió Lành", {"address"}), ("224B đường Đồi Chè, quận 2", {"address"}), ("266B Đ. Ao Súng, P. Tân Mộc", {"address"}), ("hẻm 34 Ao Súng, P.Tân Mộc", {"address"}),
    ("nhà 1/180, phố Gió Lành", {"address"}), ("I live at 182 Heron Steps Avenue.", {"address"}),
    ("quận 7, TP.HCM", set()), ("hội trường Mai Vàng", set()), ("Năm 2025 đường bưu điện", set()), ("tầng 2 nhà Hoa Phượng", set()), ("12 Đường dẫn em gửi", set()),
    ("em tên là Kiều Văn Đoan!", {"name"}), ("tôi là KIỀU THỊ ĐOAN.", {"name"}), ("bạn nguyễn diệu đoan nhờ em hỏi", {"name"}), ("For Maren Astermoor, my sister", {"name"}),
    ("Tôi là Khong Thi Astermoor - sđt", {"name"}), ("Khong Thi Astermoor", set()), ("tôi là sinh viên năm nhất", set()), ("Đoan", set()),
    ("Liên hệ 0951139561. CCCD 009396140845, hộp thư: d@post.example.org", {"phone", "id_number", "email"}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_mentions(text, want):
    assert {k for *_, k in p.mentions(text, BITS)} == want


@pytest.mark.parametrize("text,want", CASES)
def test_the_cheap_filter_lets_every_mention_through(text, want):
    hit = p._candidates(pa.array([text]), p.letter_runs(list(BITS)))[0].as_py()
    assert hit or not want


def _shape(r: random.Random) -> str:
    """Something like a mention, with separators, brackets and spaces of all kinds."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    sep = lambda: r.choice(["", " ", ".", "-"])
    gap = lambda: r.choice([" ", "\t", "\n", "\u00a0", "\u2003"])
    kinds = [
        lambda: r.choice(["+84", "(+84)", "0084", "84", "0", "(84)"]) + sep() + r.choice(["", "(0)"]) + r.choice("3456789") + d(2) + sep() + d(3) + sep() + d(r.choice([3, 4])),
        lambda: r.choice(["", "1-", "1.", "1 ", "+1", "+1 "]) + r.choice(["", "("]) + r.choice("23456789") + d(2) + r.choice(["", ")"]) + r.choice(" .-") + r.choice("23456789") + d(2) + r.choice(" .-") + d(4),
        lambda: "+" + d(r.choice([1, 2, 3])) + "".join(sep() + r.choice([d(3), f"({d(2)})", d(4)]) for _ in range(r.choice([3, 4]))) + d(2),
        lambda: r.choice(["CCCD", "Passport", "hộ chiếu", "national ID", "id no."]) + r.choice([" ", ": ", " số "]) + r.choice(["", "B"]) + r.choice([" ", "."]).join(d(1) for _ in range(r.choice([7, 8, 9, 12]))),
        lambda: r.choice(["a.b", "x_9", "q"]) + r.choice(["@", " @ ", " (at) ", "[a còng]", " a còng "]) + "lop" + r.choice([".", " chấm ", "(dot)", "[.]"]) + "example",
        lambda: r.choice(["", "số" + gap(), "Nhà" + gap()]) + d(2) + r.choice(["", "B", "/12"]) + r.choice([",", ""]) + gap() + r.choice(["đường", "Phố", "đ.", "đại lộ", "hẻm 3" + gap() + "đường"]) + r.choice(["", gap()]) + "Gió" + gap() + "Lành",
        lambda: d(3) + gap() + "Heron" + gap() + r.choice(["", "Steps "]) + r.choice(["Street", "Rd", "Lane."]),
        lambda: r.choice(["", "số "]) + d(2) + r.choice(["B", "/7", ""]) + " Lê Lợi" + r.choice(["", ", phường Ba", " Đà Nẵng"]),
        lambda: r.choice(["tên là", "Họ tên:", "my name is"]) + gap() + r.choice(["Orvane Tulquist", "orvel brisk,"]),
        lambda: "nguyễn" + " " + "diệu",
    ]
    return r.choice(["", "Gọi ", "x, ", "("]) + r.choice(kinds)() + r.choice(["", ".", " nhé", ")"])


def test_the_cheap_filter_lets_every_generated_mention_through():
    r = random.Random(7)
    runs, streets = p.letter_runs(list(BITS)), {"lê": 5.0, "lợi": 5.0}
    texts = [t for _ in range(20_000) for t in [_shape(r)]] + ["1-212-555-0123", "1.415.555.0123"]
    hit = p._candidates(pa.array(texts), runs).to_pylist()
    kinds = [{k for *_, k in p.mentions(t, BITS, streets)} for t in texts]
    assert not [t for t, h, k in zip(texts, hit, kinds) if k and not h]
    assert set().union(*kinds) == set(p.TYPES) and sum(map(bool, kinds)) > 8_000


STREETS = {w: 6.0 for w in "nguyễn huệ lê lợi trần phú".split()}
HOUSES = [
    ("Em ở 12 Nguyễn Huệ, phường Bến Nghé, Quận 1", {"address"}), ("45B Lê Lợi Đà Nẵng", {"address"}), ("số 8 Trần Phú", {"address"}), ("12/3 Trần Phú nhé", {"address"}),
    ("9 Hoa Sữa, phường 2", {"address"}), ("lớp 12 Trần Phú", set()), ("số 8 Hoa Sữa", set()), ("khoá 45B Hoa Sữa", set()), ("12 ngày lê lợi, quận 2", set()), ("phường 9, quận 2", set()),
]


@pytest.mark.parametrize("text,want", HOUSES)
def test_words_of_streets_disclose_a_house_number(text, want):
    assert {k for *_, k in p.mentions(text, {}, STREETS)} == want
    assert not want or p._candidates(pa.array([text]), p.letter_runs([]))[0].as_py()


def test_street_words_are_learned(spark):
    data = [(i, f"Em ở {i} đường {s}, quận 3", "") for i, s in enumerate(["Trần Phú", "Lê Lợi", "Nguyễn Huệ"] * 4, 1)] + [(100 + i, f"Học phí kỳ {i} là bao nhiêu, hỏi phòng đào tạo", "") for i in range(100)]
    data += [(900, "gửi về số 8 Trần Phú giúp em", ""), (901, "gửi về số 8 phòng đào tạo", "")]
    for carried in (p.CARRIED_WORDS, 0):
        got = {r.row_id for r in p.found(rows(spark, data), carried).collect() if r.pii_type == "address"}
        assert got == {*range(1, 13), 900}
    assert {r.row_id: r.text for r in p.redacted(rows(spark, data)).collect()}[900] == "gửi về [ADDRESS] giúp em"


def test_redaction_keeps_the_rest():
    text = "Chào bạn Kiều Văn Đoan, gọi 0951 501 693 hoặc a@b.example nhé."
    assert p.redact(text, BITS) == "Chào bạn [NAME], gọi [PHONE] hoặc [EMAIL] nhé."


def rows(spark, data):
    df = spark.createDataFrame(data, "id bigint, content string, text string")
    return text_rows([("m", df, F.col("id"), "content")])


CORPUS = [(i, f"Em tên là {a} {b} {c}. Học phí bao nhiêu?", "") for i, (a, b, c) in enumerate((a, b, c) for a in ("Kiều", "Mạc", "Quách") for b in ("Văn", "Thị") for c in ("Đoan", "Khuê", "Nghi"))]
CORPUS += [(100 + i, f"Tôi là sinh viên năm {i % 4}, hỏi về phòng đào tạo và học phí kỳ {i}.", "") for i in range(200)]


def test_names_are_learned_and_found_without_a_cue(spark):
    data = CORPUS + [(900, "nhờ quách văn khuê xem giúp", ""), (900, "nhờ quách văn khuê xem giúp", ""), (901, None, ""), (902, "", ""), (903, "x " * 30_000 + "gọi 0951501693", ""), (904, "Số ＣＣＣＤ ０07237236714", "")]
    got = {(r.row_id, r.pii_type) for r in p.found(rows(spark, data)).collect()}
    assert {(900, "name"), (903, "phone"), (904, "id_number")} <= got
    assert {i for i, k in got if k == "name"} == {900, *range(18)}
    texts = {r.row_id: r.text for r in p.redacted(rows(spark, data)).collect()}
    assert texts[900] == "nhờ [NAME] xem giúp" and texts[901] is None and texts[902] == "" and texts[150] == data[18 + 50][1]


def test_a_lexicon_too_large_to_carry_is_joined(spark):
    data = [*CORPUS, (900, "nhờ quách văn khuê xem giúp", "")]
    want = p.found(rows(spark, data)).collect(), p.redacted(rows(spark, data)).collect()
    got = p.found(rows(spark, data), 0).collect(), p.redacted(rows(spark, data), 0).collect()
    assert [set(x) for x in got] == [set(x) for x in want]


def test_statistics_match_plain_counts(spark):
    from collections import Counter
    import re

    got = {r.word: (r.n, r.in_names) for r in p.word_statistics(rows(spark, CORPUS)).collect()}
    plain = Counter(w for _, t, _ in CORPUS for w in re.findall(r"[^\W\d_]+", t.lower()))
    assert {w: n for w, (n, _) in got.items()} == plain
    assert got["kiều"] == (6, 6) and got["sinh"][1] == 0


def test_empty(spark):
    assert p.found(rows(spark, [])).count() == 0 and p.redacted(rows(spark, [])).count() == 0


def test_an_introduced_name_needs_no_other_rows(spark):
    texts = {0: "My name is Orvane Tulquist.", 1: "em tên là Ngạc Thụy Quyên ạ", 2: "họ tên: orvel brisk, lớp 12", 3: "HỌ TÊN: BẮT BUỘC.", 4: "Tên là bắt buộc phải ghi", 5: "họ tên: Orvane"}
    for padding in (0, 400):
        data = [(i, t, "") for i, t in texts.items()] + [(100 + i, "Tên phải bắt buộc ghi ở phòng đào tạo, học phí kỳ này bao nhiêu", "") for i in range(40 + padding)]
        assert {r.row_id for r in p.found(rows(spark, data)).collect() if r.pii_type == "name"} == {0, 1, 2}
        done = {r.row_id: r.text for r in p.redacted(rows(spark, data)).collect()}
        assert [done[i] for i in (0, 1, 2, 3)] == ["My name is [NAME].", "em tên là [NAME] ạ", "họ tên: [NAME], lớp 12", texts[3]]


def _rare(i: int) -> str:
    return "".join("bcdghklmnpqrstvx"[i // 16**k % 16] + "aeiou"[(i + k) % 5] for k in range(4))


def test_any_number_of_telling_words_is_looked_up():
    words = sorted({*BITS, *map(_rare, range(60_000))})
    texts = ["nhờ nguyễn diệu đoan hỏi", "học phí bao nhiêu", "Zed Đoan", None, ""]
    assert len(words) > 60_000 and p._candidates(pa.array(texts), p.letter_runs(words)).to_pylist() == [True, False, True, False, False]


def test_both_ways_agree_on_a_lexicon_of_sixty_thousand_words(spark):
    import unicodedata

    name = lambda i: " ".join(_rare(3 * i + k).title() for k in range(3))
    data = [(i, ". ".join(f"Em tên là {name(7 * i + k)}" for k in range(7)) + ".", "") for i in range(3_000)]
    data += [(40_000 + i, "Học phí kỳ này là bao nhiêu vậy ạ. " * 5_000, "") for i in range(64)]
    data += [(50_000 + i, unicodedata.normalize("NFD", f"tôi là {name(i).lower()} hỏi").replace("hỏi", "ｈỏi"), "") for i in range(0, 21_000, 100)]
    table = rows(spark, data).repartition(8).cache()
    assert p.learn(table).count() > 60_000
    want, got = ({tuple(r) for r in p.found(table, n).collect()} for n in (200_000, 50_000))
    assert want == got and sum(1 for _, i, kind in want if i >= 50_000 and kind == "name") == 210
    table.unpersist()


def test_disguised_names_are_joined_as_they_are_carried(spark):
    import unicodedata

    name = "gửi bạn quách văn khuê xem giúp"
    odd = [unicodedata.normalize("NFD", name), name.replace("quách", "ｑｕách"), name.replace("văn", "vă\u200bn"), name.replace("quách", "quáсh"), name.replace(" văn", "\u00a0văn")]
    data = [*CORPUS, *[(900 + i, t, "") for i, t in enumerate([name, *odd])], (950, None, "")]
    want = p.found(rows(spark, data)).collect(), p.redacted(rows(spark, data)).collect()
    assert {900 + i for i in range(6)} <= {r.row_id for r in want[0] if r.pii_type == "name"}
    got = p.found(rows(spark, data), 0).collect(), p.redacted(rows(spark, data), 0).collect()
    assert [set(x) for x in got] == [set(x) for x in want]
