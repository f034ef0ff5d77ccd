"""Conversation history and administration views.

Messages are ordered by (created_at, id) in a conversation. Operators that look back work for a
conversation of any size; top-k windows are cut before the shuffle by the optimizer's group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import sources_col, tag_value, untagged
from quern.operators.ordered import carry_rows, fragment, salted_join

ORDER = ["created_at", "id"]


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows with equal ids are one row."""
    return df.dropDuplicates([key])


def simple_role(role: Column) -> Column:
    return F.lower(F.trim(role))


def preceding_user_message(messages: DataFrame, wanted: Column) -> DataFrame:
    """As-of look back: each wanted assistant message with the latest user message before it (or null)."""
    rows = messages.filter("conversation_id is not null and created_at is not null").withColumn("r", simple_role(F.col("role"))).withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    slim = rows.filter("r = 'user' or wanted").select("conversation_id", *ORDER, "r", "wanted")
    asked = carry_rows(fragment(slim, ["conversation_id"], ORDER), ["conversation_id"], ORDER, F.when(F.col("r") == "user", F.col("id")), "user_message_id")
    return asked.filter("wanted and r = 'assistant'").select("conversation_id", F.col("id").alias("message_id"), "user_message_id")


def history_tail(messages: DataFrame, n: int = 8) -> DataFrame:
    """The last ``n`` messages of each conversation, then of those only users' and assistants'; ``turn`` ascends from 1."""
    latest = Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("id"))
    tail = messages.filter("conversation_id is not null").withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= n)
    kept = tail.filter(simple_role(F.col("role")).isin("user", "assistant"))
    turn = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("back")))
    return kept.withColumn("turn", turn).drop("back")


def domain_of(sources: Column, default: str) -> Column:
    """Domain that answered: the tagged one, else the default where records were used, else null."""
    used = F.exists(sources, lambda s: s.startswith("RAG_CONTENT:"))
    return F.coalesce(tag_value(sources, "RAG_DOMAIN:"), F.when(used, F.lit(default)))


def domain_segment(messages: DataFrame, domain: Column, default: str) -> DataFrame:
    """Messages after the latest assistant turn of another domain or without a route.

    ``domain`` is the domain whose segment is wanted, an expression over a message's conversation.
    """
    rows = messages.filter("conversation_id is not null and created_at is not null").withColumn("__domain", domain).withColumn("__src", sources_col(F.col("sources")))
    own = domain_of(F.col("__src"), default)
    ends = (simple_role(F.col("role")) == "assistant") & (F.array_contains("__src", "RAG_ROUTE:none") | F.coalesce(own != F.col("__domain"), F.lit(False)))
    at = F.struct("created_at", "id")
    last = rows.filter(ends).groupBy("conversation_id").agg(F.max(at).alias("__end"))
    kept = salted_join(rows, last, ["conversation_id"], "left").filter(F.col("__end").isNull() | (at > F.col("__end")))
    return kept.drop("__domain", "__src", "__end")


def active_titles(messages: DataFrame, domain: Column, default: str, fallback: Column) -> DataFrame:
    """``conversation_id, message_id, titles``: the titles that a conversation is about in its present ``domain``.

    They are those of the latest assistant turn that used records and named some, if no turn after it closed
    the domain: one without a route, or one of another domain. Where no turn tells, it is ``fallback``, a
    title of the conversation, in the ``default`` domain only. ``domain`` and ``fallback`` are expressions
    over the messages' columns.
    """
    rows = messages.filter("conversation_id is not null and created_at is not null")
    turns = rows.select("conversation_id", F.struct("created_at", "id").alias("at"), "id", simple_role(F.col("role")).alias("r"), sources_col(F.col("sources")).alias("src"), domain.alias("dom"), fallback.alias("legacy"))
    used = F.exists("src", lambda s: s.startswith("RAG_CONTENT:"))
    said = (F.col("r") == "assistant") & (F.array_contains("src", "RAG_ROUTE:none") | F.coalesce(domain_of(F.col("src"), default) != F.col("dom"), F.lit(False)))
    names = untagged(F.col("src"))
    tells = (F.col("r") == "assistant") & ~said & used & (F.size(names) > 0)
    got = turns.groupBy("conversation_id").agg(
        F.max(F.when(said, F.col("at"))).alias("closed"), F.max(F.when(tells, F.col("at"))).alias("told"), F.max_by(F.struct("id", names.alias("titles")), F.when(tells, F.col("at"))).alias("t"),
        F.max_by(F.when((F.col("dom") == default) & (F.col("legacy") != ""), F.col("legacy")), F.col("at")).alias("legacy"),
    )
    open_ = F.col("told").isNotNull() & (F.col("closed").isNull() | (F.col("told") > F.col("closed")))
    return got.select(
        "conversation_id", F.when(open_, F.col("t.id")).alias("message_id"),
        F.when(open_, F.col("t.titles")).when(F.col("closed").isNull() & F.col("legacy").isNotNull(), F.array("legacy")).otherwise(F.array().cast("array<string>")).alias("titles"),
    )


def latest_state(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Last state per key from an append log; earlier states are superseded."""
    state = F.max_by(F.struct(*columns), F.struct(*order)).alias("s")
    return rows.groupBy(key).agg(state).select(key, "s.*")


def append_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't there yet, each key once."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def rating_label(rating: Column) -> Column:
    return F.when(rating == 1, "positive").otherwise("negative")


def feedback_routes(rated: DataFrame) -> DataFrame:
    """Each rated row once per sink it goes to: all of them, and positive or negative ones for 1 and 0."""
    sinks = F.array_compact(F.array(F.lit("all"), F.when(F.col("rating") == 1, "positive"), F.when(F.col("rating") == 0, "negative")))
    return rated.withColumn("sink", F.explode(sinks))


def write_feedback(rated: DataFrame, folder: str) -> None:
    """Append rated rows as JSON lines to one folder per sink."""
    feedback_routes(rated).write.mode("append").partitionBy("sink").json(folder)
