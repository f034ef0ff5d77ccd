"""Problem 5: conversations rebuilt from message rows.

Clocks of senders may differ: those of the programs behind the spellings of roles, and those of the users
themselves. From the reply-before constraints (a reply comes after the question that arrived just before it)
the offset of each sender's clock is estimated by least squares; corrected times and ids order the rows of a
conversation. A conversation whose constraints can't be met, because a reply
does not follow a question in that order, is rejected, as are empty ones and ones without a reply.

Rows of a conversation are spread over range fragments, so a conversation with a third of all rows is
read by many tasks.

Edge cases, all covered by tests: rows with equal id are one row, rows with a null id are all kept, with their contents;
rows without a conversation id belong to none; roles are told apart after folding case, accents,
spaces and underscores, other spellings are no role; equal times are ordered by id; a conversation
without messages is empty; contents of any length are only tested for a visible character; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import FRAGMENT, fragment, lag_rows, rank_rows
from quern.session import cut_lineage

# Spellings of the roles after folding.
ROLES = {
    "user": ("user", "human", "khach", "khach hang", "nguoi dung", "nguoi hoi", "customer", "client", "student", "sinh vien", "hoc vien", "guest"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "tro ly", "tro ly ao", "tro ly ai", "agent", "model", "ai assistant", "may"),
    "system": ("system", "he thong", "sys", "developer"),
}
# Vietnamese letters and their plain letters, for folding roles.
_ACCENTED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_PLAIN = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"
#: A character that can be seen.
_VISIBLE = "[^\\s\\p{Z}\\p{Cc}\\p{Cf}\\u034F\\u115F\\u1160\\u17B4\\u17B5\\u2800\\u3164\\uFE00-\\uFE0F\\uFFA0]"


def fold_role(role: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.lower(role), "[\\s\\p{Z}\\p{Cf}_.:-]+", " "))
    return F.translate(F.regexp_replace(spaced, "\\p{M}+", ""), _ACCENTED, _PLAIN)


def role_of(folded: Column) -> Column:
    """user, assistant or system; null for any other spelling."""
    out = F.when(folded.isin(*ROLES["user"]), "user")
    for role in ("assistant", "system"):
        out = out.when(folded.isin(*ROLES[role]), role)
    return out


def is_blank(content: Column) -> Column:
    return ~F.coalesce(content.rlike(_VISIBLE), F.lit(False))


#: By how many standard deviations of chance the violated constraints of a clock must exceed half of them.
SURE = 3.0


def message_rows(messages: DataFrame, contents: bool = False) -> DataFrame:
    """``conversation_id, id, at, role, sender, blank`` and if asked ``content``, one row per id, of rows that name a conversation."""
    folded = fold_role(F.col("role"))
    own = F.when(F.col("id").isNull(), F.monotonically_increasing_id())  # rows without an id are told apart
    rows = messages.filter("conversation_id is not null").withColumn("__own", own).dropDuplicates(["id", "__own"])
    kept = ["content"] if contents else []
    return rows.select(
        "conversation_id", "id", F.col("created_at").alias("at"), role_of(folded).alias("role"), folded.alias("sender"), is_blank(F.col("content")).alias("blank"), *kept
    )


def _demands(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, bad, shift`` of the senders whose clock is off: constraints, violated ones, and the seconds that would meet them.

    A clock that is off violates most of its constraints, a row that came late only its own. So a clock takes
    part if the violated share exceeds one half by ``SURE`` standard deviations of chance; the more constraints
    there are, the less it takes. The shift is the median of the violated gaps and twice the distance
    from it to their tenth part, which single rows of any lateness don't move.
    """
    late = F.when(F.col("gap") < 0, -F.col("gap"))
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count(late).alias("bad"), F.percentile_approx(late, [0.5, 0.9], 10_000).alias("p"))
    off = F.col("bad") / F.col("n") > 0.5 + SURE * 0.5 / F.sqrt("n")
    return sums.filter(off).select(*keys, "n", "bad", (F.col("p")[0] + 2 * (F.col("p")[1] - F.col("p")[0]) + 1e-6).alias("shift"))


def reply_gaps(rows: DataFrame) -> DataFrame:
    """``conversation_id, a, b, gap``: seconds from each question (sender ``a``) to the reply (``b``) that arrived next."""
    known = rows.filter("role in ('user', 'assistant') and at is not null and id is not null").select("conversation_id", "id", "at", "role", "sender")
    pairs = lag_rows(fragment(known, ["conversation_id"], ["id"]), ["conversation_id"], ["id"], F.struct("sender", "role", "at"), "q")
    pairs = pairs.filter("role = 'assistant' and q.role = 'user'")
    return pairs.select("conversation_id", F.col("q.sender").alias("a"), F.col("sender").alias("b"), F.expr("timestampdiff(MICROSECOND, q.at, at) / 1e6").alias("gap"))


def clock_offsets(gaps: DataFrame) -> dict[str, float]:
    """Seconds to add to the times of each sender among the spellings of roles.

    gap + offset(reply) - offset(question) >= 0 must hold. Least squares over the demands of the pairs of
    senders gives the offsets, with their sum at zero. Senders are the known spellings of roles, so what is
    collected is bounded.
    """
    return solve_offsets([(r["a"], r["b"], r["n"], r["bad"], -r["shift"]) for r in _demands(gaps, ["a", "b"]).collect()])


def user_offsets(gaps: DataFrame, offsets: dict[str, float], conversations: DataFrame) -> DataFrame:
    """``conversation_id, behind``: seconds by which the clock of the conversation's user is still ahead of the replies.

    Each user's offset is an unknown of its own next to the settled clocks of the replies, so least squares
    has one closed solution for each user, and nothing is collected.
    """
    known = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else None
    moved = F.lit(0.0) if known is None else F.coalesce(known[F.col("b")], F.lit(0.0)) - F.coalesce(known[F.col("a")], F.lit(0.0))
    owners = conversations.select(F.col("id").alias("conversation_id"), "user_id").filter("user_id is not null").groupBy("conversation_id").agg(F.min("user_id").alias("user_id"))
    own = gaps.select("conversation_id", (F.col("gap") + moved).alias("gap")).join(owners, "conversation_id")
    return owners.join(_demands(own, ["user_id"]), "user_id").select("conversation_id", F.col("shift").alias("behind"))


def solve_offsets(shifted: list[tuple[str, str, int, int, float]]) -> dict[str, float]:
    """Least squares of offset(b) - offset(a) = -mean over (a, b, constraints, violated, mean violated gap)."""
    if not shifted:
        return {}
    names = sorted({s for a, b, *_ in shifted for s in (a, b)})
    at = {s: i for i, s in enumerate(names)}
    m, y = np.zeros((len(shifted) + 1, len(names))), np.zeros(len(shifted) + 1)
    for k, (a, b, _, bad, mean) in enumerate(shifted):
        w = bad**0.5
        m[k, at[b]], m[k, at[a]], y[k] = w, -w, -mean * w
    m[-1, :] = 1.0
    return {s: float(x) for s, x in zip(names, np.linalg.lstsq(m, y, rcond=None)[0])}


def corrected(rows: DataFrame, offsets: dict[str, float], behind: DataFrame | None = None) -> DataFrame:
    """Rows with the clocks of their senders set right, and ``shift``: the microseconds that were added."""
    moved = {s: round(x * 1e6) for s, x in offsets.items() if round(x * 1e6)}
    shift = F.coalesce(*[F.when(F.col("sender") == s, F.lit(x)) for s, x in moved.items()], F.lit(0)).cast("bigint")
    if behind is not None:
        rows = rows.join(behind, "conversation_id", "left")
        shift = shift - F.when(F.col("role") == "user", F.coalesce(F.round(F.col("behind") * 1e6), F.lit(0))).otherwise(0).cast("bigint")
    elif not moved:
        return rows.withColumn("shift", F.lit(0).cast("bigint"))
    return rows.withColumn("shift", shift).withColumn("at", F.expr("timestampadd(MICROSECOND, shift, at)")).drop("behind")


def set_right(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Rows with all clocks set right that are off."""
    gaps = cut_lineage(reply_gaps(rows))
    offsets = clock_offsets(gaps)
    behind = user_offsets(gaps, offsets, conversations)
    return corrected(rows, offsets, None if behind.isEmpty() else behind)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows in range fragments by conversation, time and id."""
    return fragment(rows, ["conversation_id"], ["at", "id"])


def verdicts(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conversation_id, reason`` of every conversation; the reason is null if it is sound. Takes the output of ``in_order``."""
    turns = rows.filter("role is null or role <> 'system'").select("conversation_id", "id", "at", "role", "blank", FRAGMENT)
    follows = lag_rows(turns, ["conversation_id"], ["at", "id"], F.col("role"), "previous")
    flags = [
        F.bool_or(~F.col("blank")).alias("said"),
        F.bool_or(
            F.col("at").isNull() | F.col("role").isNull() | ((F.col("role") == "user") & F.col("blank")) | ((F.col("role") == "assistant") & ~F.col("previous").eqNullSafe(F.lit("user")))
        ).alias("broken"),
        F.max_by("role", F.struct("at", "id")).alias("last"),
        F.bool_or((F.col("role") == "assistant") & F.col("blank")).alias("silent"),
    ]
    spoken = follows.groupBy("conversation_id").agg(*flags)
    timeless = rows.filter("role = 'system' and at is null").select("conversation_id").distinct().withColumn("timeless", F.lit(True))
    ids = conversations.select(F.col("id").alias("conversation_id"), F.lit(True).alias("known")).filter("conversation_id is not null").distinct()
    every = rows.select("conversation_id").distinct().join(ids, "conversation_id", "full").join(spoken, "conversation_id", "left").join(timeless, "conversation_id", "left")
    reason = (
        F.when(~F.coalesce("said", F.lit(False)), "empty")
        .when(F.col("known").isNull() | F.col("broken") | F.coalesce("timeless", F.lit(False)), "broken")
        .when((F.col("last") == "user") | F.col("silent"), "missing_reply")
    )
    return every.select("conversation_id", reason.alias("reason"))


def dropped(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conversation_id, reason`` of every conversation that has to be dropped."""
    rows = cut_lineage(message_rows(messages))
    return verdicts(in_order(set_right(rows, conversations)), conversations).filter("reason is not null")


def rebuilt(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conversation_id, turn_no, id, role, content, at, shift`` of the sound conversations, turns numbered from 1.

    ``shift`` tells by how many microseconds the sender's clock was set right; ``at`` is the corrected time.
    """
    ordered = in_order(set_right(cut_lineage(message_rows(messages, contents=True)), conversations))
    sound = verdicts(ordered, conversations).filter("reason is null").select("conversation_id")
    turns = rank_rows(ordered.join(sound, "conversation_id", "left_semi"), ["conversation_id"], ["at", "id"], "turn")
    return turns.select("conversation_id", (F.col("turn") + 1).cast("bigint").alias("turn_no"), "id", "role", "content", "at", "shift")
