import datetime as dt
import random

from quern.llm import conversations as c

M = "id bigint, conversation_id bigint, role string, content string, created_at timestamp_ntz, sources string, sender string"
C = "id bigint, user_id bigint, created_at timestamp_ntz, role string"
T0 = dt.datetime(2024, 1, 1)


def frames(spark, messages, conversations, users=None):
    rows = [(i, conv, role, text, None if at is None else T0 + dt.timedelta(seconds=at), "[]", "z") for i, conv, role, text, at in messages]
    return spark.createDataFrame(rows, M), spark.createDataFrame([(i, (users or {}).get(i), T0, "x") for i in conversations], C)


def reasons(spark, messages, conversations):
    return {r.conversation_id: r.reason for r in c.dropped(*frames(spark, messages, conversations)).collect()}


def test_each_reason_and_precedence(spark):
    messages = [
        (1, 1, "user", "hỏi", 1), (2, 1, "assistant", "đáp", 2),  # sound
        (3, 2, "user", " \u200b", 1), (4, 2, "assistant", None, 2), (5, 2, "system", "x", 3),  # empty
        (6, 3, "user", "hỏi", 1), (7, 3, "user", "nữa", 2), (8, 3, "Tro_Ly", "đáp", 3),  # sound
        (9, 4, "assistant", "đáp", 1), (10, 4, "user", "hỏi", 2), (11, 4, "assistant", "đáp", 3),  # broken: starts with a reply
        (12, 5, "user", "hỏi", 1), (13, 5, "assistant", "a", 2), (14, 5, "assistant", "b", 3),  # broken: two replies
        (15, 6, "user", "hỏi", 1),  # missing
        (16, 7, "user", "hỏi", 1), (17, 7, "assistant", "\u00a0", 2), (18, 7, "user", "hỏi", 3), (19, 7, "assistant", "đáp", 4),  # missing: blank reply
        (20, 8, "user", "hỏi", 1), (21, 8, "n/a", "x", 2), (22, 8, "bot", "y", 3),  # broken: no role
        (23, 9, "user", "hỏi", None), (24, 9, "bot", "y", 3),  # broken: no time
        (25, 10, "user", "", 1), (26, 10, "bot", "y", 3),  # broken: blank question
        (27, 11, "user", "hỏi", 1), (28, 11, "bot", "y", 2),  # broken: unknown conversation
        (29, 12, "user", "hỏi", 1), (30, 12, "System", None, None), (31, 12, "ai", "y", 3),  # broken: a system row without time
        (32, 13, "user", "hỏi", 1), (33, 13, "system", "s", 2), (34, 13, " khách ", "hỏi", 3), (35, 13, "human", "hỏi", 3), (36, 13, "Assistant", "y", 4),  # sound
        (37, None, "user", "hỏi", 1),
        (1, 1, "user", "hỏi", 1),  # again
    ]
    got = reasons(spark, messages, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 14])
    assert got == {2: "empty", 4: "broken", 5: "broken", 6: "missing_reply", 7: "missing_reply", 8: "broken", 9: "broken", 10: "broken", 11: "broken", 12: "broken", 14: "empty"}


def test_ties_follow_ids_and_arrival_does_not_matter(spark):
    messages = [(5, 1, "assistant", "đáp", 1), (4, 1, "user", "hỏi", 1), (7, 2, "user", "hỏi", 2), (6, 2, "assistant", "đáp", 2)]
    assert reasons(spark, messages, [1, 2]) == {2: "broken"}


def test_rebuilt_turns(spark):
    messages = [(2, 1, "bot", "đáp", 20), (1, 1, "User", "hỏi", 10), (3, 1, "system", "s", 15), (1, 1, "User", "hỏi", 10), (9, 2, "user", "?", 1)]
    got = c.rebuilt(*frames(spark, messages, [1, 2])).orderBy("turn_no").collect()
    assert [(r.conversation_id, r.turn_no, r.id, r.role, r.content) for r in got] == [(1, 1, 1, "user", "hỏi"), (1, 2, 3, "system", "s"), (1, 3, 2, "assistant", "đáp")]


def test_offsets_of_a_shifted_clock_are_found_and_corrected(spark):
    r = random.Random(1)
    messages, i = [], 0
    for conv in range(300):
        at = conv * 10_000
        for _ in range(3):
            late = r.uniform(1, 5)
            messages += [(i, conv, "user", "q", at), (i + 1, conv, "bot", "a", at + late - 60)]
            i, at = i + 2, at + 200
    m, convs = frames(spark, messages, range(300))
    offsets = c.clock_offsets(c.reply_gaps(c.message_rows(m)))
    assert 57 < offsets["bot"] - offsets["user"] < 62
    assert c.dropped(m, convs).count() == 0  # without correction all are broken
    assert {r["shift"] > 0 for r in c.rebuilt(m, convs).filter("role = 'assistant'").collect()} == {True}


def test_clocks_off_by_hours_are_found_in_small_tables_too(spark):
    messages = [x for i in range(12) for x in ((2 * i, i, "user", "q", i * 100_000), (2 * i + 1, i, "bot", "a", i * 100_000 + 4 - 7 * 3600))]
    m, convs = frames(spark, messages, range(12))
    assert abs(sum((1 if k == "bot" else -1) * v for k, v in c.clock_offsets(c.reply_gaps(c.message_rows(m))).items()) - 7 * 3600 + 4) < 1
    assert c.dropped(m, convs).count() == 0


def test_the_clock_of_one_user_is_set_right(spark):
    messages, i = [], 0
    for conv in range(40):  # two of four conversations of each user; user 3 is 90 s ahead
        ahead = 90 if conv % 10 == 3 else 0
        for turn in range(4):
            at = conv * 1000 + turn * 200
            messages += [(i, conv, "user", f"q{turn}", at + ahead), (i + 1, conv, "bot", f"a{turn}", at + 3 + turn)]
            i += 2
    m, convs = frames(spark, messages, range(40), {conv: conv % 10 for conv in range(40)})
    assert c.clock_offsets(c.reply_gaps(c.message_rows(m))) == {}
    assert c.dropped(m, convs).count() == 0
    got = c.rebuilt(m, convs).filter("conversation_id = 13").orderBy("turn_no").collect()
    assert [r.content for r in got] == ["q0", "a0", "q1", "a1", "q2", "a2", "q3", "a3"] and {r["shift"] < 0 for r in got if r.role == "user"} == {True}
    assert c.rebuilt(m, convs).filter("conversation_id % 10 <> 3 and shift <> 0").count() == 0


def test_late_rows_do_not_move_clocks(spark):
    messages = []
    for conv in range(200):
        messages += [(2 * conv, conv, "user", "q", conv * 100), (2 * conv + 1, conv, "assistant", "a", conv * 100 + (5 if conv % 5 else -40))]
    gaps = c.reply_gaps(c.message_rows(frames(spark, messages, [])[0]))
    assert c.clock_offsets(gaps) == {} and c.solve_offsets([]) == {}
    one = frames(spark, messages[:2], [0], {0: 1})
    assert c.user_offsets(c.reply_gaps(c.message_rows(one[0])), {}, one[1]).count() == 0


def test_rows_without_id_keep_their_contents(spark):
    messages = [(None, 1, "user", "hỏi", 1), (None, 1, "bot", "đáp", 2), (None, 1, "user", "nữa", 3), (None, 1, "bot", "đáp", 4), (None, 1, "system", "đáp", 5), (None, 1, "system", "đáp", 5)]
    got = c.rebuilt(*frames(spark, messages, [1])).orderBy("turn_no").collect()
    assert [(r.id, r.content) for r in got] == [(None, x) for x in ("hỏi", "đáp", "nữa", "đáp", "đáp", "đáp")]


def test_one_conversation_with_most_rows_matches_brute_force(spark):
    r = random.Random(3)
    messages = [(i, 1 if i % 2 else r.randint(2, 30), r.choice(["user", "assistant"]), "x", r.randint(0, 40)) for i in range(600)]
    by = {}
    for i, conv, role, _, at in messages:
        by.setdefault(conv, []).append((at, i, role))
    want = {}
    for conv, rows in by.items():
        rows.sort()
        roles = [x[2] for x in rows]
        if any(b == "assistant" and a != "user" for a, b in zip([None, *roles], roles)):
            want[conv] = "broken"
        elif roles[-1] == "user":
            want[conv] = "missing_reply"
    assert reasons(spark, messages, by) == want


def test_empty(spark):
    assert reasons(spark, [], []) == {}
    assert reasons(spark, [], [3]) == {3: "empty"}
    assert c.rebuilt(*frames(spark, [], [])).count() == 0
