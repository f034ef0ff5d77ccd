"""Problem 4: several values packed in one field.

A text is read as a lattice. Atoms (quoted and bracketed spans, links, words, numbers) are never cut;
between them lie candidate delimiters. A value is a run of pieces between two cuts. How often each value
occurs and how often each kind of delimiter cuts, is learned from the whole column by expectation maximisation
over all cuttings of all texts. Viterbi's algorithm then takes the likeliest cutting of each text: a
delimiter inside a value that the column knows as a whole stays uncut.

A value with delimiters inside, of whatever length, has a place in the lattice if the column tells of it: each two
neighbouring pieces of it stand together in different texts (spellings of one text are no different texts), in
more than ``TOGETHER`` of those in which either of them stands. A text without such a pair has one cutting only; it adds the same to the counts in every
round and is counted once. The rounds then run over the texts with a choice.

Edge cases, all covered by tests: null, empty and blank texts and texts of delimiters alone have no
value; rows with equal id count once; list marks and numbering are no values; a text in JSON notation
counts by its elements (null and blank ones are not counted); an unclosed quote or bracket is ordinary
text; texts of any length are read whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordered import once_each
from quern.session import cut_lineage

# Opening quotes and brackets with what closes them.
CLOSERS = {'"': '"', "“": "”", "«": "»", "„": "“", "‘": "’", "(": ")", "[": "]", "{": "}"}
#: Probability of a value that the column doesn't know, and the factor for each delimiter inside it.
UNKNOWN, INSIDE = 1e-2, 1e-7
#: Least share of the texts with either of two pieces that have them together, for them to be possibly one value.
TOGETHER = 0.02
#: A text with a larger share of all rows than this is hot; there are at most as many as its reciprocal.
HOT = 0.001
#: Prior of a candidate delimiter being a cut, and the number of delimiters it counts for.
CUT, CUT_WEIGHT = 0.9, 20.0

_LINK = re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.)[^\s;|\"“”«»<>]+", re.I)
_DELIMITER = re.compile(
    r"\s*(?:[\n\r\t;|；｜、，•·▪●◦‣]|(?<!\d),|,(?!\d)|(?<=\s)[/+&](?=\s))\s*"
    r"|\s+(?=(?:\(\d{1,3}\)|\d{1,3}\)|\d{1,3}\.)\s+\S)"
)
_MARK = re.compile(r"^(?:\(\d{1,3}\)|\d{1,3}[.)](?=\s)|[-*•·–—+▪●◦‣](?=\s))\s*")
_JSON = re.compile(r"^\s*\[.*\]\s*$", re.S)


def json_items(text: str) -> list[str] | None:
    """The elements of a JSON list, or None if the text is none."""
    if not _JSON.match(text):
        return None
    try:
        got = json.loads(text)
    except ValueError:
        return None
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in got if x is not None and (not isinstance(x, str) or x.strip())]


def _atom_end(text: str, i: int) -> int:
    """End of the atom that starts at ``i``, or ``i`` if none does."""
    c = text[i]
    if (close := CLOSERS.get(c)) and (i == 0 or not (c in "\"‘" and text[i - 1].isalnum())):
        j = i + 1
        depth = 1
        while j < len(text):
            if text[j] == close:
                if c == '"' and text[j : j + 2] == '""':
                    j += 2
                    continue
                depth -= 1
                if not depth:
                    return j + 1
            elif text[j] == c and c != close:
                depth += 1
            j += 1
        return i
    if (c.isalpha()) and (i == 0 or not text[i - 1].isalnum()) and (m := _LINK.match(text, i)):
        link = m.group()
        cut = re.search(r",(?=[^\d\s/?&=#%._~-])", link[8:])
        link = link[: 8 + cut.start()] if cut else link
        return i + len(link.rstrip(",.:"))
    return i


def pieces(text: str) -> list[tuple[str, str]]:
    """(delimiter before it, piece) of the pieces between candidate delimiters, without list marks and empty pieces."""
    out: list[tuple[str, str]] = []
    start = i = 0
    before, delimiter = "", ""

    def close(end: int) -> None:
        nonlocal before
        piece = text[start:end].strip()
        if m := _MARK.match(piece + " "):
            piece = piece[m.end() :].strip()
        if piece.strip(" .,;:|/+-–—*•·"):
            out.append((before, piece))
            before = ""

    while i < len(text):
        if (j := _atom_end(text, i)) > i:
            i = j
        elif (m := _DELIMITER.match(text, i)) and m.end() > i and not (m.start() == i and i > 0 and text[i].isspace() and text[i - 1].isspace()):
            close(i)
            delimiter = m.group().strip() or "\n"
            before = before or delimiter
            start = i = m.end()
        else:
            i += 1
    close(len(text))
    return out


_WRAPPED = re.compile(r'^(?:"(?:[^"]|"")*"|“[^“”]*”|«[^«»]*»|„[^„“]*“|‘[^‘’]*’)[.;,]?$')


def clean_value(piece: str) -> str:
    """A value without wrapping quotes and closing punctuation."""
    v = piece.strip()
    if _WRAPPED.match(v):
        v = v.rstrip(".;,")[1:-1].replace('""', '"').strip()
    elif v.endswith((".", ",", ";")):
        v = v[:-1].rstrip()
    return v


_FORMAT = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")


def value_key(field: str, value: str) -> bytes:
    """128-bit digest of a value; values that differ in composition, case or spaces only are one."""
    plain = " ".join(_FORMAT.sub("", unicodedata.normalize("NFKC", value)).casefold().split())
    return xxhash.xxh3_128_digest(f"{field}\n{plain}")


def value_of(parts: list[tuple[str, str]], i: int, j: int) -> str:
    return clean_value(parts[i][1] + "".join(f" {d} {p}" for d, p in parts[i + 1 : j]))


def spans_of(size: int, together: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first piece, piece after the last) of every value that a lattice of ``size`` pieces allows.

    ``together``: (k, texts) of each pair of pieces k and k + 1 that may be one value, in order. Longer values
    are runs of such pairs. A value that begins or ends within a run stands in texts without the pair across
    its end, so that pair has fewer texts than the one next to it inside; all other places are no ends.
    """
    out = [(i, i + 1) for i in range(size)]
    texts = dict(together)
    for start in (k for k in texts if k - 1 not in texts):
        stop = start
        while stop in texts:
            stop += 1
        inner = [k for k in range(start + 1, stop + 1) if texts[k - 1] < max(texts.get(k, 0) if k < stop else 0, texts[k - 2] if k - 2 >= start else 0)]
        ends = [start, *inner, stop + 1]
        out += [(i, j) for i in ends for j in ends if j - i > 1]
    return sorted(out)


Spans = list[tuple[int, int, float]]


def span_weights(spans: list[tuple[int, int]], counts: list[float], total: float, marks: str, cuts: dict[str, float]) -> Spans:
    """(first piece, piece after the last, weight) of each span, whose values occur ``counts`` times among ``total``.

    The weight is the probability of the value, times that of its inner delimiters being no cuts and of
    the one after it being one. A value with delimiters inside is known from other rows only, so one
    occurrence is not counted. ``marks`` has the delimiter before each piece but the first.
    """
    cut = [cuts.get(d, CUT) for d in marks]
    out = []
    for (i, j), c in zip(spans, counts):
        p = max(c / total, UNKNOWN) if j - i == 1 else max(0.0, c - 1) / total + UNKNOWN * INSIDE ** (j - i - 1)
        for k in range(i, j - 1):
            p *= 1 - cut[k]
        if j - 1 < len(cut):
            p *= cut[j - 1]
        out.append((i, j, p))
    return out


def cohesion_weights(spans: list[tuple[int, int]], counts: list[float]) -> Spans:
    """First weights of spans from raw occurrences: 1 for a piece, and for more pieces how exclusively they occur together.

    ``c(whole)^m / product of c(piece)`` over the ``m`` pieces is 1 if none is ever seen without the
    others, and falls fast with every other neighbour it has.
    """
    alone = {i: c for (i, j), c in zip(spans, counts) if j - i == 1}
    return [(i, j, math.prod(min(1.0, c / max(alone[k], c, 1e-9)) for k in range(i, j)) ** 4 if j - i > 1 else 1.0) for (i, j), c in zip(spans, counts)]


def expected_counts(n: int, spans: Spans) -> list[float]:
    """Posterior probability of each span being a value of the text (forward-backward over the lattice of ``n`` pieces)."""
    if n <= 8:
        ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, w in sorted(spans):
            ahead[j] += ahead[i] * w
        for i, j, w in sorted(spans, reverse=True):
            back[i] += back[j] * w
        if ahead[n] > 1e-250:
            return [ahead[i] * w * back[j] / ahead[n] for i, j, w in spans]
    nothing = -math.inf
    ahead, back = [0.0] + [nothing] * n, [nothing] * n + [0.0]  # logarithms: long texts have no room in a float
    logs = [(i, j, math.log(w) if w > 0 else nothing) for i, j, w in spans]
    for i, j, w in sorted(logs):
        ahead[j] = _log_add(ahead[j], ahead[i] + w)
    for i, j, w in sorted(logs, reverse=True):
        back[i] = _log_add(back[i], back[j] + w)
    return [math.exp(ahead[i] + w + back[j] - ahead[n]) if ahead[n] > nothing else 0.0 for i, j, w in logs]


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a >= b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def best_cutting(n: int, spans: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The likeliest sequence of spans over ``n`` pieces (Viterbi); on ties the one with more cuts."""
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, -1)] * n
    for i, j, w in sorted(spans, key=lambda s: (s[1], -s[0])):
        score = best[i][0] + (math.log(w) if w > 0 else -math.inf)
        if score > best[j][0]:
            best[j] = (score, i)
    out, j = [], n
    while j > 0:
        i = best[j][1]
        out.append((i, j))
        j = i
    return out[::-1]


def marks_of(parts: list[tuple[str, str]]) -> str:
    """One sign for each delimiter between pieces."""
    return "".join(d[0] for d, _ in parts[1:])


_LATTICE = "sid binary, field string, text string, n bigint, size int, marks string, keys array<binary>, pairs array<binary>, content bigint"


def _lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the pieces of each distinct text and of its pairs of neighbouring pieces. JSON lists are certain already: they have only their elements."""
    for b in batches:
        sizes, marks, keys, pairs, content = [], [], [], [], []
        known: dict[tuple[str, str], bytes] = {}

        def key(field: str, value: str) -> bytes:
            if (got := known.get((field, value))) is None:
                got = known[field, value] = value_key(field, value)
            return got

        for field, text in zip(b.column("field").to_pylist(), b.column("text").to_pylist()):
            items = json_items(text)
            parts = pieces(text) if items is None else []
            items = [value_of(parts, i, i + 1) for i in range(len(parts))] if items is None else [clean_value(x) for x in items]
            sizes.append(len(items))
            marks.append(marks_of(parts))
            keys.append([key(field, v) for v in items])
            pairs.append([key(field, value_of(parts, i, i + 2)) for i in range(len(parts) - 1)])
            content.append(xxhash.xxh64_intdigest("".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())) - 2**63)
        columns = [*(b.column(c) for c in ("sid", "field", "text", "n")), pa.array(sizes, pa.int32()), pa.array(marks, pa.string())]
        columns += [pa.array(keys, pa.list_(pa.binary())), pa.array(pairs, pa.list_(pa.binary())), pa.array(content, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["sid", "field", "text", "n", "size", "marks", "keys", "pairs", "content"])


def choices(lattices: DataFrame) -> DataFrame:
    """``sid, together``: the texts with more than one cutting, and their pairs of pieces that may be one value (position, texts with the pair)."""
    singles = lattices.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("texts"))
    at = lattices.filter("size > 1").select("sid", "keys", "content", F.posexplode("pairs").alias("pos", "pair"))
    both = at.select("pair", F.get("keys", F.col("pos")).alias("left"), F.get("keys", F.col("pos") + 1).alias("right"), "content")
    seen = both.groupBy("pair", "left", "right").agg(F.count("*").alias("texts"), F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high")
    for side in ("left", "right"):
        of = singles.select(F.col("key").alias(side), F.col("texts").alias(f"{side}_texts"))
        seen = seen.join(of, side).filter(F.col("texts") > TOGETHER * F.col(f"{side}_texts"))
    held = seen.groupBy("pair").agg(F.sum("texts").alias("texts"))
    return at.select("sid", "pos", "pair").join(held, "pair").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "texts"))).alias("together"))


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the texts with a choice, with the keys of their values."""
    for b in batches:
        firsts, lasts, keys = [], [], []
        for field, text, size, together in zip(*(b.column(c).to_pylist() for c in ("field", "text", "size", "together"))):
            parts, spans = pieces(text), spans_of(size, [(x["pos"], x["texts"]) for x in together])
            firsts.append([i for i, _ in spans])
            lasts.append([j for _, j in spans])
            keys.append([value_key(field, value_of(parts, i, j)) for i, j in spans])
        columns = [*(b.column(c) for c in ("sid", "field", "n", "marks")), *(pa.array(x, pa.list_(pa.int32())) for x in (firsts, lasts)), pa.array(keys, pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, names=["sid", "field", "n", "marks", "first", "last", "keys"])


_SPANNED = "sid binary, field string, n bigint, marks string, first array<int>, last array<int>, keys array<binary>"
_COUNT = "field string, key binary, mark string, c double, n double"


def _estimate(step: int, totals: dict[str, float], cuts: dict[str, dict[str, float]]):
    """Counts of a batch: of values (``key``) and of delimiters that cut among all (``mark``).

    Raw occurrences of all spans in step 0, then expected ones, first by cohesion and then by the model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values: dict[tuple[str, bytes], float] = defaultdict(float)
            cut: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
            for field, n, marks, first, last, keys, counts in zip(*(b.column(c).to_pylist() for c in ("field", "n", "marks", "first", "last", "keys", "counts"))):
                if not step:
                    for k in keys:
                        values[field, k] += n
                    continue
                spans, size = list(zip(first, last)), len(marks) + 1
                weights = cohesion_weights(spans, counts) if step == 1 else span_weights(spans, counts, totals[field], marks, cuts.get(field, {}))
                for k, (_, j), p in zip(keys, spans, expected_counts(size, weights)):
                    if p > 1e-9:
                        values[field, k] += p * n
                        if j < size:
                            cut[field, marks[j - 1]][0] += p * n
                for d in marks:
                    cut[field, d][1] += n
            columns = {
                "field": pa.array([*(f for f, _ in values), *(f for f, _ in cut)], pa.string()),
                "key": pa.array([*(k for _, k in values), *(None for _ in cut)], pa.binary()),
                "mark": pa.array([*(None for _ in values), *(d for _, d in cut)], pa.string()),
                "c": pa.array([*values.values(), *(c for c, _ in cut.values())], pa.float64()),
                "n": pa.array([*(0.0 for _ in values), *(float(n) for _, n in cut.values())], pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _looked_up(spanned: DataFrame, model: DataFrame) -> DataFrame:
    """Texts with a choice and what the model knows of their values (``counts``, in the order of ``keys``)."""
    spans = spanned.select("sid", F.posexplode("keys").alias("pos", "key")).join(model.groupBy("key").agg(F.sum("c").alias("c")), "key", "left")
    known = spans.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("c", F.lit(0.0)).alias("c"))))["c"].alias("counts"))
    return spanned.join(known, "sid")


def learn_values(lattices: DataFrame, chosen: DataFrame, spanned: DataFrame, rounds: int = 3) -> tuple[DataFrame, dict[str, float], dict[str, dict[str, float]]]:
    """(``key, c``: expected occurrences of the values of texts with a choice, sums of all by field, probability of a cut by field and delimiter) after ``rounds`` of EM."""
    certain = lattices.join(chosen.select("sid"), "sid", "left_anti")
    there = spanned.select(F.explode("keys").alias("key")).distinct()
    singles = certain.select("field", "n", F.explode("keys").alias("key")).groupBy("field", "key").agg(F.sum("n").cast("double").alias("c"))
    fixed = cut_lineage(singles.join(there, "key", "left_semi").select("field", "key", "c"))
    sums: dict[str, float] = {r[0]: float(r[1]) for r in certain.groupBy("field").agg(F.sum(F.col("n") * F.size("keys"))).collect()}
    marks = certain.filter("marks <> ''").select("field", "n", F.explode(F.split("marks", "")).alias("mark")).filter("mark <> ''").groupBy("field", "mark").agg(F.sum("n"))
    always: dict[tuple[str, str], float] = {(r[0], r[1]): float(r[2]) for r in marks.collect()}  # one row per column and kind of delimiter
    model, totals, cuts = None, {}, {}
    for step in range(rounds + 1):
        known = _looked_up(spanned, model) if model is not None else spanned.withColumn("counts", F.lit(None).cast("array<double>"))
        counts = cut_lineage(known.mapInArrow(_estimate(step, totals, cuts), _COUNT).groupBy("field", "key", "mark").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
        model = counts.filter("mark is null").select("key", "c").unionByName(fixed.select("key", "c"))
        totals, chance = dict(sums), {k: [c, c] for k, c in always.items()}
        for r in counts.groupBy("field", "mark").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
            if r["mark"] is None:
                totals[r["field"]] = totals.get(r["field"], 0.0) + r["c"]
            else:
                was = chance.setdefault((r["field"], r["mark"]), [0.0, 0.0])
                was[0], was[1] = was[0] + r["c"], was[1] + r["n"]
        cuts = {}
        for (field, mark), (c, n) in chance.items():
            cuts.setdefault(field, {})[mark] = (c + CUT * CUT_WEIGHT) / (n + CUT_WEIGHT)
    return model, totals, cuts


def _cut(totals: dict[str, float], cuts: dict[str, dict[str, float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for field, text, marks, first, last, counts in zip(*(b.column(c).to_pylist() for c in ("field", "text", "marks", "first", "last", "counts"))):
                items = json_items(text)
                if items is None:
                    parts = pieces(text)
                    spans = [(i, i + 1) for i in range(len(parts))]
                    if counts is not None:
                        spans = best_cutting(len(parts), span_weights(list(zip(first, last)), counts, totals[field], marks, cuts.get(field, {})))
                    items = [value_of(parts, i, j) for i, j in spans]
                out.append(items)
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("text"), b.column("n"), pa.array(out, pa.list_(pa.string()))], names=["field", "text", "n", "items"])

    return run


def distinct_texts(columns: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """``field, text, n, sid`` of the distinct non-blank texts of the named columns. Exact copies are cut once."""
    parts = [df.select(F.lit(name).alias("field"), c.cast("string").alias("text")) for name, df, c in columns]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    counts = union.filter(F.col("text").rlike(r"\S")).groupBy("field", "text").agg(F.count("*").alias("n"))
    return counts.withColumn("sid", F.unhex(F.md5(F.concat("field", F.lit("\n"), "text"))))


def _to_rows(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with the cuts of their texts. Hot texts, few by definition, are sent to the rows; the rest is shuffled."""
    by = ["field", "text"]
    least = HOT * (cuts.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(cuts.filter(F.col("n") > least).select(*by, "items"))
    cold = cuts.filter(F.col("n") <= least).select(*by, "items")
    return rows.join(hot, by).unionByName(rows.join(hot.select(*by), by, "left_anti").join(cold, by))


def split_columns(columns: list[tuple[str, DataFrame, Column, Column]], rounds: int = 3) -> DataFrame:
    """``field, row_id, item_no, items, value``: one row per value, numbered from 1 in order, ``items`` of them in the row.

    ``columns``: name of the field, its table, its id column, its text column. Each field has its own
    value frequencies. A text with one value yields that one row.
    """
    lattices = cut_lineage(distinct_texts([(name, df, text) for name, df, _, text in columns]).mapInArrow(_lattice, _LATTICE))
    chosen = cut_lineage(choices(lattices))
    spanned = cut_lineage(lattices.join(chosen, "sid").mapInArrow(_spanned, _SPANNED))
    model, totals, chances = learn_values(lattices, chosen, spanned, rounds)
    known = _looked_up(spanned, model).select("sid", "first", "last", "counts")
    cuts = lattices.join(known, "sid", "left").select("field", "text", "n", "marks", "first", "last", "counts").mapInArrow(_cut(totals, chances), "field string, text string, n bigint, items array<string>")
    rows = None
    for name, df, rid, text in columns:
        part = once_each(df.select(F.lit(name).alias("field"), rid.alias("row_id"), text.cast("string").alias("text")), "row_id")
        rows = part if rows is None else rows.unionByName(part)
    found = _to_rows(rows, cut_lineage(cuts))
    every = found.select("field", "row_id", F.size("items").alias("n"), F.posexplode("items").alias("pos", "value"))
    return every.select("field", "row_id", (F.col("pos") + 1).cast("bigint").alias("item_no"), F.col("n").cast("bigint").alias("items"), "value")
