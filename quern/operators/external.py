"""Results of external searches: URL rules, cleaning, grounded support and an offline search table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quern.functions.text import strip

# Longest URL, title and snippet of a search result.
LONGEST_URL, LONGEST_TITLE, LONGEST_SNIPPET = 4096, 300, 2500


def url_host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user info, control characters or blanks; null for any other text."""
    clean = ~url.rlike(r"[\x00-\x20\x7f]") & (F.length(url) <= LONGEST_URL)
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#@:\\]+)(?::\d{1,5})?(?:[/?#]|$)", 1))
    return F.when(clean & (host != ""), F.rtrim(host, F.lit(".")))


def allowed(url: Column, hosts: list[str]) -> Column:
    """Whether the URL's host is one of ``hosts`` or below one."""
    host = url_host(url)
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (host == h.lower()) | host.endswith("." + h.lower())
    return F.coalesce(hit, F.lit(False))


def clean_results(results: DataFrame, hosts: list[str], limit: int) -> DataFrame:
    """Results of allowed URLs with a snippet, each URL once per request by position, cut and limited; ``no`` counts from 1.

    ``results``: ``request_id, position, url, title, snippet``.
    """
    rows = results.filter(allowed(F.col("url"), hosts) & (F.coalesce(strip(F.col("snippet")), F.lit("")) != ""))
    first = Window.partitionBy("request_id", "url").orderBy("position")
    once = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    order = Window.partitionBy("request_id").orderBy("position")
    kept = once.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= limit)
    return kept.select("request_id", "no", "url", F.substring(F.coalesce("title", F.lit("")), 1, LONGEST_TITLE).alias("title"), F.substring(strip(F.col("snippet")), 1, LONGEST_SNIPPET).alias("snippet"))


def grounded_support(claims: DataFrame, hosts: list[str]) -> DataFrame:
    """``claim_id, source_no, url`` of claims all of whose cited sources are allowed; one disallowed source drops the claim.

    ``claims``: ``claim_id, cited`` (0-based positions)``, urls``.
    """
    cited = F.transform("cited", lambda i: F.get("urls", i.cast("int")))
    rows = claims.withColumn("cited_urls", cited).filter((F.size("cited") > 0) & F.forall("cited_urls", lambda u: F.coalesce(allowed(u, hosts), F.lit(False))))
    return rows.select("claim_id", F.posexplode("cited_urls").alias("p", "url")).select("claim_id", (F.col("p") + 1).alias("source_no"), "url")


def site_clause(hosts: Column) -> Column:
    return F.array_join(F.transform(hosts, lambda h: F.concat(F.lit("site:"), h)), " OR ")


def search_function(search: Callable[[str, int], list[tuple[str, str, str]]]):
    """A table function (query, count) -> title, url, snippet over an injected search; it never goes to a network itself."""

    @udtf(returnType="title: string, url: string, snippet: string")
    class Search:
        def eval(self, query: str, count: int) -> Iterator[tuple[str, str, str]]:
            if query and query.strip():
                yield from search(query, count)[:count]

    return Search


#: Forms that one automaton holds; a larger catalogue is searched in parts, each over all rows.
PART = 200_000


def _first_form(forms: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ahocorasick.Automaton()
        for no, form in sorted(forms, reverse=True):  # of equal forms the first in the catalogue stays
            if form:
                found.add_word(form, no)
        found.make_automaton()
        blank = [no for no, form in forms if form == ""]

        def first(text: str | None) -> int | None:
            hits = [no for _, no in found.iter(text)] if text and len(found) else []
            return min(hits + blank, default=None) if text is not None else None

        for b in batches:
            out = []
            for row, title, question in zip(*(b.column(c).to_pylist() for c in ("row_id", "title", "question"))):
                for source, text in enumerate((title, question)):
                    if (no := first(text)) is not None:
                        out.append((row, source, no))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((b.schema.field("row_id").type, pa.int32(), pa.int64()))], names=["row_id", "source", "form_no"])

    return run


def match_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """First catalogue form whose title a text contains: titles first, then questions, then catalogue order.

    ``rows``: ``row_id, title, question`` (normalised); ``forms``: ``form_no, form`` (normalised). All forms of
    a part of the catalogue are looked for in one pass over a text.
    """
    catalogue = forms.filter("form_no is not null and form is not null").select(F.col("form_no").cast("bigint"), "form")
    parts = -(-catalogue.count() // PART)
    found = None
    for part in range(parts):
        some = [tuple(r) for r in catalogue.filter(F.pmod(F.xxhash64("form"), F.lit(parts)) == part).collect()]
        here = rows.select("row_id", "title", "question").mapInArrow(_first_form(some), f"row_id {rows.schema['row_id'].dataType.simpleString()}, source int, form_no bigint")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return rows.limit(0).selectExpr("row_id", "0L as form_no", "'' as matched_by")
    best = found.groupBy("row_id").agg(F.min(F.struct("source", "form_no")).alias("b"))
    return best.select("row_id", "b.form_no", F.when(F.col("b.source") == 0, "title").otherwise("question").alias("matched_by"))
