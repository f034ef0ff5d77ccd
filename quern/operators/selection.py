"""From candidates to evidence: what a model is shown, and what its validated reply selects.

Model calls stay outside: a reply is a column of text. A reply that breaks the contract has a defined
result: all fields, an invalid selection, no route. Nothing is guessed from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import is_ascii, plain_words_col, strip
from quern.operators.retrieval import excerpt
from quern.session import cut_lineage

# Fields that are always shown where they exist; lengths of shown titles, samples and scopes; least, most and whole budget of excerpts.
ALWAYS = ("description", "content")
TITLE, SAMPLE, SCOPE = 160, 180, 180
LEAST, MOST, BUDGET = 120, 500, 2600
#: So many bytes of telling phrases at most are sent to every task; bytes that a row has besides its texts.
SENT_BYTES, ROW_BYTES = 16 << 20, 64


def json_list(reply: Column) -> Column:
    """The items of a JSON list as text, with or without a fence around it; null for anything else."""
    bare = F.regexp_replace(F.trim(reply), r"(?s)^```(?i:json)?\s*(.*?)\s*```$", "$1")
    return F.when(F.trim(bare).startswith("["), F.from_json(bare, "array<string>"))


def selected_fields(explicit: Column, reply: Column, allowed: list[str]) -> Column:
    """Fields to show: those the question names, then the reply's, each once; with a reply that is no list of allowed
    fields, or nothing selected, all of them. Descriptive fields are added where they exist."""
    known, chosen = F.array(*map(F.lit, allowed)), json_list(reply)
    sound = chosen.isNotNull() & F.forall(chosen, lambda k: F.coalesce(F.array_contains(known, k), F.lit(False)))
    wanted = F.array_distinct(F.concat(explicit, chosen))
    picked = F.when(F.coalesce(sound, F.lit(False)) & (F.size(wanted) > 0), wanted).otherwise(known)
    return F.array_union(picked, F.array(*[F.lit(k) for k in ALWAYS if k in allowed]).cast("array<string>"))


def selected_records(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """``query_id, valid, pos, vec_id``: the candidates that a reply selects, in its order, each once.

    ``candidates``: ``query_id, rank`` (from 1)``, vec_id``; ``replies``: ``query_id, reply``, a JSON list of 0-based
    indices. A reply with anything else in it selects nothing: one row with ``valid`` false. An empty list is valid
    and has no row.
    """
    sizes = candidates.groupBy("query_id").agg(F.max("rank").alias("n"))
    items = json_list(F.col("reply"))
    index = F.transform("items", lambda x: F.when(x.rlike("^[0-9]{1,9}$"), x.cast("int")))
    judged = replies.select("query_id", items.alias("items")).join(sizes, "query_id").withColumn("index", index)
    valid = F.coalesce(F.forall("index", lambda i: F.coalesce(i < F.col("n"), F.lit(False))), F.lit(False))
    rows = judged.select("query_id", valid.alias("valid"), F.when(valid, F.array_distinct("index")).otherwise(F.array(F.lit(None).cast("int"))).alias("index"))
    picked = rows.select("query_id", "valid", F.posexplode("index").alias("pos", "at"))
    at = candidates.select("query_id", (F.col("rank") - 1).alias("at"), "vec_id")
    return picked.join(at, ["query_id", "at"], "left").select("query_id", "valid", F.when(F.col("valid"), F.col("pos")).alias("pos"), "vec_id")


def selector_rows(candidates: DataFrame, key: str, order: str, title: str, fields: list[tuple[str, str]]) -> DataFrame:
    """What a selector sees of each request's candidates: ``index`` from 0, the title and its plain form, both cut, and an
    excerpt whose budget shrinks with the number of candidates."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    budget = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.floor(F.lit(BUDGET) / n))).cast("int")
    shown = F.coalesce(F.col(f"`{title}`"), F.lit(""))
    rows = candidates.withColumn("index", at).withColumn("__budget", budget)
    return rows.select(key, order, "index", F.substring(shown, 1, TITLE).alias("title"), F.substring(plain_words_col(shown), 1, TITLE).alias("plain_title"), excerpt(fields, F.col("__budget")).alias("excerpt"))


def passage(scope: str, fields: list[tuple[str, str]], longest: int = 1800) -> Column:
    """An excerpt under the scope of its dataset."""
    head = f"Dataset scope: {scope[:SCOPE]}\n" if scope else ""
    return F.concat(F.lit(head), excerpt(fields, longest))


def field_samples(rows: DataFrame, key: str, order: str, fields: list[tuple[str, str]], most: int = 2) -> DataFrame:
    """Per key, of its first ``most`` rows the filled values of each field, cut."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("__n") <= most)
    samples = []
    for c, label in fields:
        value = F.col(f"`{c}`")
        kept = F.when(F.coalesce(strip(value), F.lit("")) != "", F.substring(value, 1, SAMPLE))
        ordered = F.array_sort(F.collect_list(F.when(kept.isNotNull(), F.struct("__n", kept.alias("v")))))
        samples.append(ordered["v"].alias(label))
    return first.groupBy(key).agg(*samples)


def discovery_queries(resolved: Column, original: Column, prepared: Column) -> Column:
    """The queries to search by, each once in order: the resolved one, the original if it has ASCII letters only, the prepared phrases. Blank ones search nothing."""
    every = F.concat(F.array(resolved), F.when(is_ascii(original), F.array(original)).otherwise(F.array().cast("array<string>")), prepared)
    return F.filter(F.array_distinct(every), lambda q: F.coalesce(strip(q) != "", F.lit(False)))


def pinned(candidates: DataFrame, active: DataFrame, keys: list[str], title: str) -> DataFrame:
    """Candidates whose title is, in plain form, one of the active titles of their request."""
    own = candidates.withColumn("__plain", plain_words_col(F.col(f"`{title}`")))
    wanted = active.select(*keys, plain_words_col(F.col("title")).alias("__plain")).filter("__plain <> ''").distinct()
    return own.join(wanted, [*keys, "__plain"], "left_semi").drop("__plain")


def contextual_query(titles: Column, prompt: Column, followup: Column) -> Column:
    """A continuation carries the titles it continues; any other prompt stands alone."""
    alone = strip(prompt)
    return F.when(followup & (F.size(titles) > 0), F.concat(F.array_join(titles, "; "), F.lit(". "), alone)).otherwise(alone)


def specific_owners(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """``question_id, owner``: the owners of a question's most specific phrases.

    ``questions``: ``question_id, phrases``; ``titles``: ``owner, phrases`` (arrays of n-grams). A phrase tells if the
    titles of one owner only hold it; of a question's telling phrases, one within a longer one doesn't count.
    """
    owned = titles.select("owner", F.explode("phrases").alias("phrase")).filter("owner is not null")
    one = owned.groupBy("phrase").agg(F.min("owner").alias("owner"), F.max("owner").alias("__last")).filter("owner = __last").drop("__last")
    one = cut_lineage(one)
    size = one.agg(F.sum(F.octet_length("phrase") + F.octet_length(F.col("owner").cast("string")) + ROW_BYTES)).first()[0] or 0
    # named either way: estimated from the size of its file, the exploded side would be taken for the small one and be sent
    one = F.broadcast(one) if size <= SENT_BYTES else one.hint("merge")
    told = questions.select("question_id", F.explode("phrases").alias("phrase")).join(one, "phrase")
    words, none = F.split("phrase", " "), F.lit(None).cast(one.schema["owner"].dataType)
    part = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.struct(F.array_join(F.slice(words, i, k), " ").alias("phrase"), none.alias("owner")))
    inner = F.when(F.col("question_id").isNotNull() & (F.size(words) > 1), F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - 1), part)))
    own = F.array(F.struct("phrase", "owner"))
    # each phrase with its owner, and without one where it stands in a longer phrase; questions without id are no one question
    every = told.select("question_id", F.explode(F.concat(own, F.coalesce(inner, F.slice(own, 1, 0)))).alias("p")).select("question_id", "p.*")
    alone = every.groupBy("question_id", "phrase").agg(F.max("owner").alias("owner"), F.bool_or(F.col("owner").isNull()).alias("within")).filter("not within")
    return alone.select("question_id", "owner").distinct()


def route_of(reply: Column, names: list[str]) -> Column:
    """The route of a reply that is a JSON object with ``route`` alone and a known name in it; null for any other."""
    route = F.get_json_object(reply, "$.route")
    return F.when((F.json_object_keys(reply) == F.array(F.lit("route"))) & route.isin(*names), route)


def closed_list(reply: Column) -> Column:
    """A JSON list of objects that lacks only its last bracket, closed; sound JSON stays; null for anything else."""
    text = F.trim(reply)
    whole = F.try_parse_json(text).isNotNull()
    closed = F.concat(text, F.lit("]"))
    items = F.from_json(closed, "array<string>")
    repaired = text.startswith("[") & text.endswith("}") & F.try_parse_json(closed).isNotNull() & (F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    return F.when(whole, text).when(F.coalesce(repaired, F.lit(False)), closed)


def answer_plan(plan: Column, documents: Column, allowed: list[str], missing: str) -> Column:
    """The answer that a plan describes, or null if the plan is not sound.

    ``plan``: JSON list of ``{"record", "fields"}``; ``documents``: an array of maps label -> value, with ``title``.
    A sound plan covers each document once and names allowed fields only. Sections follow the documents,
    fields the plan, each once; values that say nothing become ``missing``.
    """
    items = F.from_json(plan, "array<struct<record:int,fields:array<string>>>")
    known = F.array(*map(F.lit, allowed))
    order = F.array_sort(F.transform(items, lambda i: i["record"]))
    n = F.size(documents)
    sound = items.isNotNull() & (F.size(items) == n) & (order == F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))))
    sound = sound & F.forall(items, lambda i: i["fields"].isNotNull() & F.forall(i["fields"], lambda f: F.coalesce(F.array_contains(known, f), F.lit(False))))

    def section(i: Column) -> Column:
        doc = F.get(documents, i["record"])
        value = lambda f: F.coalesce(F.trim(F.element_at(doc, f)), F.lit(""))
        line = lambda f: F.concat(F.lit("- "), f, F.lit(": "), F.when(F.lower(value(f)).isin("", "nan", "không có thông tin"), F.lit(missing)).otherwise(value(f)))
        body = F.array_join(F.transform(F.array_distinct(i["fields"]), line), "\n")
        return F.concat(F.element_at(doc, F.lit("title")), F.lit(":\n"), F.when(F.size(i["fields"]) > 0, body).otherwise(F.lit(missing + ".")))

    return F.when(sound, F.array_join(F.transform(F.array_sort(items), section), "\n\n"))


def public_fields(document: Column, allowed: list[str]) -> Column:
    """The allowed members of a JSON object as a map of text; null for anything else."""
    return F.map_filter(F.from_json(document, "map<string,string>"), lambda k, _: k.isin(*allowed))


def sound_hosts(hosts: Column) -> Column:
    """Host names in lower case without a final dot, each once; null if one of them is none."""
    plain = F.transform(hosts, lambda h: F.rtrim(F.lower(F.trim(h)), F.lit(".")))
    good = F.forall(plain, lambda h: F.coalesce(h.rlike(r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,63}$"), F.lit(False)))
    return F.when(good, F.array_distinct(plain))
