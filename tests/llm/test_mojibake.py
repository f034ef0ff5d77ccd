import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.llm import mojibake as m

VI = "Sinh viên nộp hồ sơ ở phòng đào tạo trước ngày 5. Học phí được hoàn nếu hủy trước hạn. "
EN = "The café beside the desk’s “quick lane” keeps forms – see the registry. The fee is €5. "
FR = "L’élève étranger présente son relevé. Les frais s’élèvent à 5 euros jusqu’à la fin de l’été. "


@pytest.fixture(scope="module")
def length():
    texts = [VI, EN, FR, "该专业每学期学费为5百万越南盾。"]
    return m.DescriptionLength({str(i): (t * 3).encode() for i, t in enumerate(texts)}, frozenset("".join(texts)))


def garble(text, codec):
    return "".join(chr(b) if not (c := bytes([b]).decode(codec, "ignore")) else c for b in text.encode())


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1258"])
@pytest.mark.parametrize("text", [VI, EN])
def test_round_trip_of_utf8_read_wrongly(length, codec, text):
    bad = garble(text, codec)
    assert bad != text
    got, chains = m.restore(bad, length)
    assert got == text and chains


def test_round_trip_of_twice_and_of_legacy(length):
    assert m.restore(garble(garble(VI, "cp1252"), "cp1252"), length)[0] == VI
    bytes_ = unicodedata.normalize("NFC", VI)
    spelled = "".join(unicodedata.normalize("NFC", x) for x in bytes_)
    raw = b"".join(_cp1258(c) for c in spelled)
    assert m.restore(raw.decode("cp1252"), length)[0] == VI


def _cp1258(c):
    try:
        return c.encode("cp1258")
    except UnicodeEncodeError:
        d = unicodedata.normalize("NFD", c)
        tone = [x for x in d if x in "\u0300\u0301\u0303\u0309\u0323"]
        base = unicodedata.normalize("NFC", "".join(x for x in d if x not in tone))
        return base.encode("cp1258") + "".join(tone).encode("cp1258")


def test_only_the_garbled_part_changes(length):
    text = VI + garble(EN, "cp1252") + VI
    assert m.restore(text, length)[0] == VI + EN + VI


@pytest.mark.parametrize("text", [VI, EN, FR, "BẢO TRÌ C147: ĐÃ XONG", "ATENÇÃO: AS INSCRIÇÕES VÃO ATÉ O DIA 3", "├── mau_don\n└── bien_lai", "√ đã nộp; 60×90 mm, ¾ trang; 12 € / ±5%", "该专业每学期", "", "  "])
def test_sound_texts_stay(length, text):
    assert m.restore(text, length) == (text, [])


RU = "Студент подаёт заявление в учебный отдел до пятого числа. Плата возвращается полностью. "
ZH, JA = "该专业每学期学费为5百万越南盾。申请材料请在三天内交到学生服务处。", "学生は申請書を窓口に提出してください。料金は無料です。"
TH, KO = "นักศึกษายื่นคำร้องที่สำนักทะเบียนก่อนวันที่ 5", "학생은 신청서를 창구에 제출하십시오. 수수료는 없습니다."


@pytest.fixture(scope="module")
def wide():
    texts = [VI, EN, FR, RU, ZH, JA, TH, KO]
    return m.DescriptionLength({str(i): (t * 3).encode() for i, t in enumerate(texts)}, frozenset("".join(texts)))


@pytest.mark.parametrize("codec", ["latin-1", "cp1252"])
def test_a_chain_of_three(wide, codec):
    assert m.restore(garble(garble(garble(VI, codec), codec), codec), wide)[0] == VI


def test_a_chain_of_different_codecs(wide):
    assert m.restore(garble(garble(VI, "mac_roman"), "cp1251"), wide)[0] == VI


@pytest.mark.parametrize("codec", ["cp874", "gbk", "cp932"])
def test_utf8_read_by_codecs_of_other_scripts(wide, codec):
    good = "Phòng đào tạo"
    bad = good.encode().decode(codec, "surrogateescape")
    if not any("\udc80" <= c <= "\udcff" for c in bad):
        assert m.restore(bad, wide)[0] == good
    bad = "".join(c if c == " " else (w if "\ufffd" not in (w := c.encode().decode(codec, "replace")) else c) for c in RU)
    if bad != RU:
        assert m.restore(bad, wide)[1]


@pytest.mark.parametrize("was,read", [("koi8_r", "cp1251"), ("cp1251", "koi8_r")])
def test_cyrillic_codecs_mixed_up(wide, was, read):
    got, chains = m.restore(RU.encode(was).decode(read), wide)
    assert got == RU and chains


@pytest.mark.parametrize("text", [RU, ZH, JA, TH, KO, "联通", "毛 隆", "ยก", "中文 và tiếng Việt", "РУССКИЙ язык", "Привет, МИР", "カード№3"])
def test_sound_texts_of_other_scripts_stay(wide, text):
    assert m.restore(text, wide) == (text, [])


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, restored string")


def test_table_with_nulls_repeats_long_and_lost(spark):
    bad = garble(VI, "cp1252")
    rows = [(i, VI + str(i), "vi", "x") for i in range(10, 40)]
    rows += [(1, bad, "vi", "x"), (1, bad, "vi", "x"), (2, None, None, "x"), (3, "", "vi-VN", "x"), (4, " \n", None, "x"), (5, VI * 300 + bad, None, "x"), (6, "K�nh thực hiện", "vi", "x"), (None, bad, "vi", "x")]
    df = table(spark, rows)
    args = (F.col("doc_id"), F.col("text"), F.col("lang"))
    assert sorted(r.doc_id for r in m.garbled(df, *args).collect()) == [1, 5, 6]
    got = {r.doc_id: r for r in m.restored(df, *args).collect() if r.garbled}
    assert got[1].restored == VI and got[5].restored == VI * 301 and got[1].whole and not got[6].whole
    assert m.garbled(df.limit(0), *args).count() == 0


def test_bom_of_a_wrong_decoding_is_dropped(length):
    assert m.restore("ï»¿" + VI, length)[0] == VI


def test_the_alphabet_is_of_all_sound_texts_and_the_sample_of_distinct_ones(spark, monkeypatch):
    monkeypatch.setattr(m, "LONGEST_DRAWN", 400)
    rows = [(i, VI + str(i), "vi", "x") for i in range(30)] + [(100 + i, VI, "vi", "x") for i in range(500)]
    rows += [(1000, "Πληροφορίες για τις αιτήσεις", None, "x"), (1001, "გამარჯობა", "ka", "x"), (1002, "часто " * 200, "vi", "x"), (1003, garble("日本", "cp1252"), "ja", "x")]
    seen = {}
    monkeypatch.setattr(m.zstandard, "train_dictionary", lambda size, texts: seen.setdefault("texts", texts) and m.zstandard.ZstdCompressionDict(b"x" * 64))
    _, alphabet = m.train(table(spark, rows).repartition(3), F.col("text"), F.col("lang"), per_language=20, languages=1)
    assert set("Πφίგაч") | set(VI) <= alphabet and not alphabet & set("日本æ")
    assert len(seen["texts"]) == 20 == len(set(seen["texts"]))


def test_passages_of_an_unlabelled_language_are_restored(spark):
    greek = "Οι αιτήσεις υποβάλλονται στη γραμματεία. Τα έντυπα είναι δωρεάν."
    rows = [(i, VI + str(i), "vi", "x") for i in range(40)] + [(100, greek, None, "x")]
    df = table(spark, rows)
    args = (F.col("doc_id"), F.col("text"), F.col("lang"))
    _, alphabet = m.train(df, args[1], args[2])
    assert set(greek) - set(VI) - set(" .") <= alphabet
    bad = [(200 + i, garble("Οι αιτήσεις.", c), None, "x") for i, c in enumerate(("mac_roman", "cp437", "cp1251"))]
    assert {r.doc_id: r.restored for r in m.restored(df.union(table(spark, bad)), *args).collect() if r.garbled} == {b[0]: "Οι αιτήσεις." for b in bad}


def test_dictionaries_are_of_all_sound_texts_however_rows_lie(spark):
    words = [f"mã{i * 7919 % 100003}" for i in range(4000)]
    rows = [(i, f"Hồ sơ {words[i]} nộp tại phòng {words[-i]}.", "vi", "x") for i in range(2000)]
    rows += [(3000 + i, f"the {w} desk", lang, "x") for i, (w, lang) in enumerate(zip(words, ["en"] * 40 + ["de"] * 40 + [None] * 40))]
    rows += [(4000, "Điều khoản dài nhất của quy chế. " * 1000, "vi", "x"), (4001, garble(VI, "cp1252"), "vi", "x"), (4002, "  ", None, "x")]
    df = table(spark, rows + rows[:50])
    by, alphabet = m.train(df.repartition(3), F.col("text"), F.col("lang"), languages=2)
    assert set(by) == {"vi", "de", ""}
    assert b"\xc4\x90i\xe1\xbb\x81u kho\xe1\xba\xa3n" in by["vi"]  # of the long text
    assert all(w.encode() in by[""] for w in words[:40] + words[80:120]) and "Ã" not in alphabet and "Đ" in alphabet
    assert (by, alphabet) == m.train(df.orderBy(F.desc("doc_id")).repartition(7), F.col("text"), F.col("lang"), languages=2)


def test_dictionaries_of_parts_become_one(spark, monkeypatch):
    monkeypatch.setattr(m, "TRAINED_BYTES", 2000)
    monkeypatch.setattr(m, "FAN", 3)
    df = table(spark, [(i, VI + str(i), "vi", "x") for i in range(300)] + [(1000, EN, "en", "x")])
    by, _ = m.train(df, F.col("text"), F.col("lang"))
    assert set(by) == {"vi", "en"} and by["en"] == EN.encode() and len(by["vi"]) <= 32768
    assert "phòng đào tạo".encode() in by["vi"]
