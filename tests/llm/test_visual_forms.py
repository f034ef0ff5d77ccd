import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.llm import visual_forms as v

DISGUISED = [
    ("Ｈọｃ phí １２", "Học phí 12"),
    ("𝐇ọ𝐜 bổng", "Học bổng"),
    (unicodedata.normalize("NFD", "nộp lệ phí"), "nộp lệ phí"),
    ("b\u200bạn\u2060 ơi\ufeff", "bạn ơi"),
    ("học\u00a0phí\u2009là\u3000gì", "học phí là gì"),
    ("Нạn cuối nộp hồ sơ ở đâu, саn", "Hạn cuối nộp hồ sơ ở đâu, can"),
    ("boоk a fеe", "book a fee"),
    ("tu\u00adition", "tuition"),
    ("phὸng giό", "phòng gió"),
    ("Ðề án Ɖịa tin, 9 Ð. Lò Rèn", "Đề án Địa tin, 9 Đ. Lò Rèn"),
    ("\u00a0", " "),
    ("\u200b", ""),
    ("５０ ① ﬁle", "50 1 file"),
]
PLAIN = ["", "Học phí là 5 đồng", "«русский язык»", "Hệ số α của môn", "“ngoặc” – gạch…", "👩\u200d🎓 ok", "a\tb\nc", "kΩ và μm", "Straße naïve €5 §2", "Ðæð", "❤️ nhé"]


@pytest.mark.parametrize("text,plain", DISGUISED)
def test_disguised_texts_get_their_plain_form(text, plain):
    assert v.plain_form(text) == plain
    assert unicodedata.normalize("NFC", v.skeleton(text)) != text


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_stay(text):
    assert v.plain_form(text) == text


@pytest.mark.parametrize("text,plain", DISGUISED)
def test_skeletons_of_look_alikes_are_equal(text, plain):
    assert v.skeleton(text) == v.skeleton(plain)


WIDE = [
    ("ᎪᏢᏚ A", "APS A"), ("xin Ꭺnh", "xin Anh"), ("ʜọᴄ phí", "học phí"), ("ꓮnh", "Anh"), ("Ⲥường", "Cường"), ("ѵip", "vip"), ("vıp", "vip"), ("сlаѕѕ", "class"), ("boοk", "book"), ("Ьảo", "bảo"), ("ոộp", "nộp"),
]


@pytest.mark.parametrize("text,plain", WIDE[1:])
def test_letters_of_all_alphabets_in_the_list(spark, text, plain):
    f = v.Forms(v.confusables(spark))
    got, disguise = f.plain(text)
    assert disguise and got.lower() == plain.lower()


def test_the_list_gives_groups_and_unknown_letters_are_cases(spark):
    f = v.Forms(v.confusables(spark))
    assert f.skeleton("ΑΙ Ꭺl") == f.skeleton("Al A1") and f.skeleton("rnod 10") == f.skeleton("mod lO")
    for text in ("hoжc phi", "tuiλtion", "nộфp"):
        assert f.plain(text)[1]
    for text in [*PLAIN, "ışık için ğ", "LMS에서 xem", "该专业LMS", "カードA", "Ω", "ᎪᏢᏚ", "Nº 5", "Đề án", "нет", "5 µm, Δt"]:
        assert f.plain(text) == (text, False)


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, content string, text string, plain string")


def run(spark, rows):
    df = table(spark, rows)
    return v.text_rows([("m", df, F.col("id"), "content")])


def test_disguised_rows_once_and_null_and_long(spark):
    long = "học phí " * 20_000
    rows = [(1, "Ｈọc", "", ""), (1, "Ｈọc", "", ""), (2, None, "", ""), (3, "", "", ""), (4, long, "", ""), (5, long + "\u200b", "", ""), (6, "\u00a0 ", "", "")]
    got = v.disguised(run(spark, rows)).collect()
    assert sorted(r.row_id for r in got) == [1, 5, 6]
    forms = {r.row_id: r.plain for r in v.forms(run(spark, rows)).collect()}
    assert forms[2] is None and forms[3] == "" and forms[5] == long and forms[6] == "  "


def test_groups_of_look_alikes(spark):
    rows = [(1, "Hạn", "", ""), (2, "Нạn", "", ""), (3, "Нạn", "", ""), (4, "khác", "", ""), (5, None, "", "")]
    got = v.look_alikes(run(spark, rows)).collect()
    assert [(r.skeleton, r.texts, r["rows"]) for r in got] == [("Hạn", 2, 3)]


def test_empty(spark):
    assert v.disguised(run(spark, [])).count() == 0 and v.forms(run(spark, [])).count() == 0


def test_texts_that_the_filter_passes_over_are_their_own_forms():
    import re

    suspect = re.compile(v.SUSPECT)
    for code in [*range(0x20, 0x3000), *range(0xA640, 0xA800), *range(0xFB00, 0x10000)]:
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if not suspect.search(c):
            assert v.plain_form("a" + c) == "a" + c, hex(code)
            assert unicodedata.normalize("NFC", v.skeleton("a" + c)) == "a" + v.ASCII_PROTOTYPES.get(c, c), hex(code)
