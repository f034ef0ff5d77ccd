"""Runs and their evaluation: caches, transcripts, scenarios, variants, numeric checks, spans and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import compact_letters_col, plain_words_col, similarity_col
from quern.operators.ordered import carry_rows, fragment, group_percentiles, rank_rows

# How answers say, in plain words, that something isn't known.
ABSENT = (
    r"(?:khong|chua)\s+(?:co|tim thay|cung cap)\s+(?:thong tin|du lieu)"
    r"|(?:thong tin|du lieu)[^\n.!?]{0,100}(?:khong|chua)\s+(?:co|duoc cung cap)"
)
# Units of a price, in plain words.
UNITS = ("san pham", "don vi", "ban", "the", "may", "gio", "luot", "nguoi", "ngay", "thang", "nam", "kg", "lit", "ve", "phong")


# -- caches and latencies --------------------------------------------------------------------------


def with_cache(results: DataFrame, events: DataFrame) -> DataFrame:
    """Results with their request's last cache event: ``cached`` (there is one)``, cache_hit, cache_enabled``.

    ``events``: ``request_id, seq, cache_hit, cache_enabled``.
    """
    last = events.groupBy("request_id").agg(F.max_by(F.struct("cache_hit", "cache_enabled"), "seq").alias("c"))
    rows = results.join(last, "request_id", "left")
    return rows.withColumn("cached", F.col("c").isNotNull()).withColumn("cache_hit", F.coalesce("c.cache_hit", F.lit(False))).withColumn("cache_enabled", F.col("c.cache_enabled")).drop("c")


def uncached(rows: DataFrame) -> DataFrame:
    """Results that no cache answered."""
    return rows.filter(~F.col("cache_hit"))


def cache_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``cache_events, cache_hits, acknowledged, cacheless``: counted per result; cacheless if there are events, none a hit and all with the cache off."""
    counts = rows.groupBy(*keys).agg(F.count_if("cached").alias("cache_events"), F.count_if("cache_hit").alias("cache_hits"), F.count_if(F.col("cache_enabled") == F.lit(False)).alias("acknowledged"))
    return counts.withColumn("cacheless", (F.col("cache_events") > 0) & (F.col("cache_hits") == 0) & (F.col("acknowledged") == F.col("cache_events")))


def full_context(events: DataFrame, keys: list[str]) -> DataFrame:
    """``verified``: whether a run's cache and completion events, some of each, are all in full mode and nothing was selected.

    ``events``: ``kind`` (cache, complete, selection)``, mode``.
    """
    some = lambda kind: F.count_if(F.col("kind") == kind)
    full = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("mode") == "full"))
    verified = (some("cache") > 0) & (some("complete") > 0) & (some("selection") == 0) & (some("cache") == full("cache")) & (some("complete") == full("complete"))
    return events.groupBy(*keys).agg(verified.alias("verified"))


# -- transcripts and captures ----------------------------------------------------------------------


def transcript(turns: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """``place, source, at, id`` and the keys: summed-up turns, and messages of no such turn, in the order of time; ``place`` counts from 1.

    Both have ``at``, ``id`` and the keys; keys that are null are equal to none.
    """
    loose = messages.join(turns.select(*keys).distinct(), keys, "left_anti")
    every = turns.select(F.lit("turn").alias("source"), "at", "id", *keys).unionByName(loose.select(F.lit("message").alias("source"), "at", "id", *keys))
    order = ["at", "source", "id"]
    return rank_rows(fragment(every, [], order), [], order, "place").withColumn("place", F.col("place") + 1).drop("__fragment")


def capture_check(records: DataFrame, status: str, body: str, required: list[str]) -> DataFrame:
    """One row: ``statuses`` (map), ``malformed`` (bodies that are no JSON), ``missing`` (rows without a required value) and ``verdict``."""
    lacks = ~F.lit(True)
    for c in required:
        lacks = lacks | F.col(c).isNull() | (F.col(c).cast("string") == "")
    rows = records.select(F.coalesce(status, F.lit("?")).alias("s"), (F.col(body).isNull() | F.try_parse_json(body).isNull()).alias("bad"), lacks.alias("lacks"))
    by = rows.groupBy("s").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.count_if("lacks").alias("lacks"))
    out = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("statuses"), F.coalesce(F.sum("bad"), F.lit(0)).alias("malformed"), F.coalesce(F.sum("lacks"), F.lit(0)).alias("missing"))
    return out.withColumn("verdict", F.when((F.col("malformed") == 0) & (F.col("missing") == 0) & (F.size("statuses") > 0), "pass").otherwise("needs_review"))


# -- scenarios and variants ------------------------------------------------------------------------


def runnable(scenarios: DataFrame, available: Column) -> DataFrame:
    """Scenarios with ``missing``: the required domains that are not available; those with none can run."""
    return scenarios.withColumn("missing", F.array_sort(F.array_except("requires", available))).withColumn("runs", F.size("missing") == 0)


def required_domains(scenarios: DataFrame) -> DataFrame:
    """All domains that some scenario requires, each once."""
    return scenarios.select(F.explode("requires").alias("domain")).distinct()


def with_manifest(results: DataFrame, manifest: DataFrame, key: str = "scenario") -> DataFrame:
    """Results of scenarios that the manifest has, with its columns."""
    return results.join(manifest, key)


def says_absent(answer: Column) -> Column:
    """Whether an answer says that information is absent."""
    return F.coalesce(plain_words_col(answer).rlike(ABSENT), F.lit(False))


def variant_summary(rows: DataFrame, variant: str, value: str, flag: str) -> DataFrame:
    """``n, mean, median, flagged`` per variant; the mean and median over rows with a value."""
    counts = rows.groupBy(variant).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))
    stats = group_percentiles(rows, [variant], value, {"median": 0.5}).drop("n")
    return counts.alias("c").join(stats.alias("s"), F.col(f"c.{variant}").eqNullSafe(F.col(f"s.{variant}")), "left").select(F.col(f"c.{variant}").alias(variant), "n", "mean", "median", "flagged")


def distinct_options(runs: DataFrame, options: list[str]) -> DataFrame:
    """The different settings that runs were made with, and how many runs had each."""
    return runs.groupBy(*options).agg(F.count("*").alias("runs"))


# -- numeric checks --------------------------------------------------------------------------------


def even_ids(rows: DataFrame, key: str, most: int = 32) -> DataFrame:
    """Rows at evenly spread places of the sorted keys, first and last included; all if there are no more than ``most``."""
    n = rows.count()
    places = sorted({int(i * (n - 1) / (min(most, n) - 1)) for i in range(min(most, n))}) if n > 1 else [0]
    return rank_rows(fragment(rows, [], [key]), [], [key], "place").filter(F.col("place").isin(places)).drop("__fragment")


def vector_check(pairs: DataFrame, keys: list[str], error: float = 0.05, cosine: float = 0.99) -> DataFrame:
    """``n, max_error, min_cosine, usable, small_difference`` of pairs of vectors ``actual, expected``."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    apart = F.array_max(F.zip_with("actual", "expected", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    norms = F.sqrt(dot(F.col("actual"), F.col("actual"))) * F.sqrt(dot(F.col("expected"), F.col("expected")))
    got = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.max(apart).alias("max_error"), F.min(dot(F.col("actual"), F.col("expected")) / norms).alias("min_cosine"))
    usable = (F.col("max_error") <= error) & (F.col("min_cosine") >= cosine)
    return got.withColumn("usable", usable).withColumn("small_difference", (F.col("min_cosine") < 0.99999) | (F.col("max_error") > 0.001))


def order_changes(scores: DataFrame, group: str, item: str, actual: str, expected: str) -> DataFrame:
    """``changed`` per group: whether two scorings rank its items differently (ties by item)."""
    by = lambda c: F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), F.col(item).alias("i"))))["i"]
    return scores.groupBy(group).agg((by(actual) != by(expected)).alias("changed"))


def placements(events: DataFrame, provider: Column) -> DataFrame:
    """Events per provider; events without one are no placement."""
    return events.select(provider.alias("provider")).filter("coalesce(provider, '') <> ''").groupBy("provider").agg(F.count("*").alias("n"))


def fastest(samples: DataFrame, size: str, value: str) -> DataFrame:
    """One row: the size with the least median, on ties the smallest, with its median."""
    medians = group_percentiles(samples, [size], value, {"median": 0.5})
    return medians.agg(F.min_by(F.struct(size, "median"), F.struct("median", size)).alias("b")).select("b.*").filter(F.col(size).isNotNull())


def prompt_size(parts: Column) -> Column:
    """Characters of all parts of a prompt."""
    return F.aggregate(parts, F.lit(0), lambda s, x: s + F.coalesce(F.length(x), F.lit(0)))


# -- spans -----------------------------------------------------------------------------------------


def paired_spans(events: DataFrame, keys: list[str], order: list[str], ts: str, start: Column, end: Column) -> DataFrame:
    """Each end with the latest start before it of the same keys, and the milliseconds between; null without a start."""
    rows = events.filter(F.coalesce(start, F.lit(False)) | F.coalesce(end, F.lit(False)))
    began = carry_rows(fragment(rows, keys, order), keys, order, F.when(start, F.col(ts)), "started_at")
    return began.filter(end).drop("__fragment").withColumn("elapsed_ms", F.expr(f"timestampdiff(MICROSECOND, started_at, {ts})") / 1000)


def lock_times(spans: DataFrame, task: str, value: str) -> DataFrame:
    """``lock, waits, waited, holds, held``: tasks end in .wait and .held; others are no locks."""
    parts = F.regexp_extract(task, r"^(.*)\.(wait|held)$", 1), F.regexp_extract(task, r"^(.*)\.(wait|held)$", 2)
    rows = spans.select(parts[0].alias("lock"), parts[1].alias("part"), F.col(value).alias("v")).filter("part <> ''")
    of = lambda p, f: f(F.when(F.col("part") == p, F.col("v")))
    return rows.groupBy("lock").agg(of("wait", F.count).alias("waits"), of("wait", F.sum).alias("waited"), of("held", F.count).alias("holds"), of("held", F.sum).alias("held"))


def outcome(error: Column, cancelled: list[str], control: list[str]) -> Column:
    """ok without an error's name, control_flow and cancelled by name, else error."""
    return F.when(F.coalesce(error, F.lit("")) == "", "ok").when(error.isin(*control), "control_flow").when(error.isin(*cancelled), "cancelled").otherwise("error")


def activity(events: DataFrame, labels: dict[str, str], starts: list[str]) -> DataFrame:
    """Events worth showing, with a ``message``: failures, ends of labelled tasks, and starts of those in ``starts``.

    ``events``: ``task, event, status, error, elapsed_ms``.
    """
    label = F.coalesce(*[F.when(F.col("task") == k, F.lit(v)) for k, v in labels.items()], F.lit(None).cast("string"))
    failed = F.coalesce(F.col("status") == "error", F.lit(False)) | F.coalesce(F.col("event") == "failure", F.lit(False))
    shown = failed | (label.isNotNull() & ((F.col("event") == "end") | ((F.col("event") == "start") & label.isin(*starts))))
    said = F.when(F.col("event") == "start", " working...").when(F.col("status") == "cancelled", " cancelled").otherwise(" finished")
    took = F.when(F.col("elapsed_ms").isNotNull(), F.concat(F.lit(" ("), F.format_string("%.2f", F.col("elapsed_ms") / 1000), F.lit(" s)"))).otherwise("")
    message = F.when(failed, F.concat(F.coalesce(label, F.col("task")), F.lit(": ERROR "), F.coalesce("error", F.lit("")))).otherwise(F.concat(label, said, took))
    return events.filter((F.coalesce("status", F.lit("")) != "control_flow") & shown).withColumn("message", message)


# -- audits ----------------------------------------------------------------------------------------


def source_audit(rows: DataFrame, targets: DataFrame, group: str, key: str, title: str, most: int = 5) -> DataFrame:
    """Per group and its target: rows scanned, titles that hold the target, the first ``most`` of them, and a status.

    ``targets``: the group column and ``target``. Titles and targets are compared as letters and digits alone. A group
    without rows has the status unavailable.
    """
    wanted = targets.select(group, "target", compact_letters_col(F.col("target")).alias("__t"))
    seen = rows.select(group, key, compact_letters_col(F.coalesce(F.col(f"`{title}`"), F.lit(""))).alias("__k")).join(wanted, group, "right")
    hit = F.contains("__k", "__t") & (F.col("__t") != "")
    ranked = seen.withColumn("__hit", F.coalesce(hit, F.lit(False))).withColumn("__no", F.row_number().over(Window.partitionBy(group, "__hit").orderBy(key)))
    got = ranked.groupBy(group, "target").agg(
        F.count(key).alias("scanned"), F.count_if("__hit").alias("matches"), F.array_sort(F.collect_list(F.when(F.col("__hit") & (F.col("__no") <= most), F.col(key)))).alias("first_matches")
    )
    return got.withColumn("status", F.when(F.col("scanned") == 0, "unavailable").when(F.col("matches") > 0, "title_matches_found").otherwise("no_title_match"))


def nearest_titles(rows: DataFrame, targets: DataFrame, group: str, title: str, most: int = 3) -> DataFrame:
    """Per group the ``most`` different titles most similar to its target (Ratcliff-Obershelp over letters and digits), best first."""
    wanted = targets.select(group, compact_letters_col(F.col("target")).alias("__t"))
    titles = rows.select(group, F.col(f"`{title}`").alias("title")).filter("title is not null").distinct().join(wanted, group)
    near = titles.select(group, "title", similarity_col(F.col("__t"), compact_letters_col(F.col("title"))).alias("ratio"))
    return near.withColumn("no", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("ratio"), F.desc("title")))).filter(F.col("no") <= most)


def per_unit(text: Column) -> Column:
    """Plain words of a text in which "one <unit> ... <price>" also reads as a price per unit, so that both spellings of a rate are alike.

    ``<price>/<unit>`` and "each" in its other word read so too. A negation or reduction between unit and price, or
    another unit after the price, tells against it.
    """
    unit = "(?:" + "|".join(UNITS) + ")"
    plain = F.regexp_replace(plain_words_col(text), rf"(?<![a-z])(dong|vnd|d)\s*/\s*({unit})\b", "$1 moi $2")
    plain = F.regexp_replace(plain, rf"\btung\s+({unit})\b", "moi $1")
    rate = rf"\b(?:mot|1)\s+({unit})\b([^.!?]{{0,80}}?)\d[\d., ]*\s*(?:dong|vnd|d)\b(?=((?:\s*moi\s+{unit}\b)?))"
    of = lambda i: F.regexp_extract_all(plain, F.lit(rate), F.lit(i))
    found = F.arrays_zip(of(1).alias("unit"), of(2).alias("between"), of(3).alias("after"))
    linking = lambda x: (F.trim(x) == "") | x.rlike(r"\b(?:la|gia|phi|tinh|ton|het)\b")
    holds = F.filter(
        found,
        lambda m: ~m["between"].rlike(r"\b(?:khong|chua|mien|tru|giam)\b") & linking(m["between"]) & ((m["after"] == "") | m["after"].rlike(r"^\s*moi ") & (F.trim(F.regexp_replace(m["after"], r"^\s*moi\s+", "")) == m["unit"])),
    )
    words = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_.,]+", " "))
    return F.array_join(F.concat(F.array(words), F.transform(holds, lambda m: F.concat(F.lit("moi "), m["unit"]))), " ")


def newest_first(rows: DataFrame, keys: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """Rows numbered from the newest per key (``no``), for keys of any size; with ``most`` only so many."""
    if most is not None:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        return rows.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= most)
    ranked = rank_rows(fragment(rows, keys, order), keys, order, "__up")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    return ranked.join(sizes, keys).withColumn("no", (F.col("__n") - F.col("__up")).cast("bigint")).drop("__n", "__up", "__fragment")


def oldest_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows numbered from the oldest per key (``no``), for keys of any size."""
    return rank_rows(fragment(rows, keys, order), keys, order, "no").withColumn("no", F.col("no") + 1).drop("__fragment")
