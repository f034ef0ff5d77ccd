import random

import pytest
from pyspark.sql import functions as F

from quern.llm import pair_defects as p

Q = "Học phí ngành Toán mô phỏng năm 2025 là bao nhiêu ạ?"
CASES = [
    (Q, None, "empty"), (Q, "", "empty"), (Q, " \u200b\n", "empty"), (Q, "N/A", "empty"), (Q, "{}", "empty"), (Q, "—", "empty"), (Q, "None", "empty"), (Q, "...", "empty"),
    (Q, "Xin lỗi, tôi không thể trả lời câu hỏi này.", "refusal"),
    (Q, "Tiếc quá, mình không có dữ liệu về mục này. Bạn vui lòng liên hệ Phòng Đào tạo.", "refusal"),
    (Q, "Rất tiếc, đợt đầu đã đóng, nhưng đợt sau vẫn nhận. Hạn là ngày 05/06/2025.", None),
    (Q, "Xin lỗi vì để bạn chờ. Học phí là 5.000.000 đồng.", None),
    (Q, "Mình chưa thấy mục này trong dữ liệu đã nạp. Bạn có muốn mình tra cứu trên mạng không?", None),
    (Q, "học phí ngành toán mô phỏng năm 2025 là bao nhiêu ạ", "copies_question"),
    (Q, "HOC PHI NGANH TOAN MO PHONG NAM 2025 LA BAO NHIEU A!", "copies_question"),
    (Q, "Bạn hỏi: Học phí ngành Toán mô phỏng năm 2025 là bao nhiêu ạ?", "copies_question"),
    (Q, "“Học phí ngành Toán mô phỏng năm 2025 là bao nhiêu?”", "copies_question"),
    (Q, "Học phí ngành Toán mô phỏng năm 2025 là miễn phí.", None),
    (Q, "Học phí ngành Toán mô phỏng năm 2025 là bao nhiêu ạ? Học phí ngành Toán mô phỏng năm 2025 là 4.000.000 đồng.", None),
    ("Mã ngành X của Học viện Cầu Mây có phải 123 không?", "Đúng vậy, ngành X của Học viện Cầu Mây dùng mã 123.", None),
    (Q, "The fee is 4 million dong and is paid at the registry.", "other_language"),
    (Q, "图书可以续借2次。", "other_language"),
    ("How much is tuition in 2025?", "Học phí năm 2025 là 4.000.000 đồng.", "other_language"),
    ("hoc phi nganh toan nam 2025 la bao nhieu a?", "Học phí năm 2025 là 4.000.000 đồng.", None),
    (Q, "Bạn submit form trên LMS trước ngày 05/06/2025.", None),
    (Q, "Học phí là 4.000.000 đồng. Lưu ý (chỉ dành cho", "truncated"),
    (Q, "Học phí là 4.000.000 đồng. **Lưu", "truncated"),
    (Q, "Học phí là 4.000.000 đồng. Sau 5 ngày không đến nhận,", "truncated"),
    (Q, "Hồ sơ gồm:\n1. giấy khai sinh\n2.", "truncated"),
    (Q, "Hồ sơ gồm:\n1. giấy khai sinh\n2. thẻ sinh viên", None),
    (Q, "Trước 7 giờ 15 ngày 27/08/2022", None), (Q, "Miễn phí", None), (Q, "Tại nhà C", None), (Q, "Phí gia h", "truncated"),
    (None, "Học phí là 4.000.000 đồng.", None), ("", "Miễn phí", None),
]


@pytest.mark.parametrize("prompt,response,want", CASES)
def test_cases(prompt, response, want):
    assert p.defect(prompt, response) == want


@pytest.mark.parametrize("seed", range(20))
def test_automaton_matches_brute_force(seed):
    r = random.Random(seed)
    prompt = [r.choice("abc") for _ in range(r.randint(0, 12))]
    response = [r.choice("abcd") for _ in range(r.randint(0, 15))]
    inside = {tuple(prompt[i:j]) for i in range(len(prompt)) for j in range(i, len(prompt) + 1)} | {()}
    want = [max(n for n in range(k + 2) if tuple(response[k + 1 - n : k + 1]) in inside) for k in range(len(response))]
    runs = p.SuffixAutomaton(prompt).runs(response)
    assert runs == want
    for least in (1, 2, 3):
        cover = [False] * len(runs)
        for k, n in enumerate(want):
            if n >= least:
                cover[k - n + 1 : k + 1] = [True] * n
        assert p.covered(runs, least) == cover


def test_rows_once_and_other_columns(spark):
    rows = [(1, Q, "", "x"), (1, Q, "", "x"), (2, Q, "Miễn phí", "x"), (3, None, None, "x"), (None, Q, "", "x"), (4, Q, "Học phí là 4 đồng. " * 5000, "x"), (5, Q, "Học phí là 4 đồng. " * 5000 + "Lưu ý (", "x")]
    df = spark.createDataFrame(rows, "id bigint, user_query string, llm_final_response string, defect string")
    got = p.defects(df, F.col("id"), F.col("user_query"), F.col("llm_final_response"))
    assert sorted((r.id, r.defect) for r in got.collect()) == [(1, "empty"), (3, "empty"), (5, "truncated")]
    assert p.defects(df.limit(0), F.col("id"), F.col("user_query"), F.col("llm_final_response")).count() == 0


@pytest.mark.parametrize("text", [
    "I won't answer that.", "I am afraid that is something I must leave unanswered.", "Câu này mình xin không trả lời nhé.", "Rất tiếc, " + "theo những quy định hiện hành về việc cung cấp nội dung cho người dùng thì " * 4 + "mình không thể trả lời câu hỏi này.",
    "Về năm 2024, mình không có thông tin.", "This question is outside my area, sorry.",
])
def test_refusals_of_any_length_and_wording(text):
    assert p.defect("Năm 2024 học phí là bao nhiêu?", text) in ("refusal", "other_language") and p.refuses(text, "Năm 2024 học phí là bao nhiêu?")


@pytest.mark.parametrize("text", ["Mình không có thông tin năm 2025, năm 2024 là 5 triệu.", "Phòng không trả lời qua điện thoại.", "Trường không cung cấp chỗ ở, bạn hỏi phòng 205."])
def test_sentences_that_inform_are_no_refusals(text):
    assert not p.refuses(text, "Năm 2024 học phí là bao nhiêu?")


def test_a_long_lead_in_before_a_copy():
    asked = "Thủ tục bảo lưu kết quả học tập gồm những bước nào?"
    assert p.defect(asked, "Dạ vâng, cảm ơn bạn đã gửi câu hỏi đến trợ lý của trường, câu hỏi mà bạn vừa gửi đến là: " + asked) == "copies_question"


def test_foreign_terms_do_not_hide_the_language_of_a_question():
    assert p.language("deadline submit form hoan thi tren lms la khi nao?", 1) == "vi"
    assert p.defect("deadline submit form hoan thi tren lms la khi nao?", "The article covers how to change the programme and the fee is paid at the desk.") == "other_language"


def test_a_copied_question_that_sounds_like_declining_is_a_copy():
    asked = "em là sinh viên thì có được mượn máy qua biểu mẫu trực tuyến không ạ Mong được phản hồi sớm!"
    assert p.defect(asked, asked + ".") == "copies_question"
