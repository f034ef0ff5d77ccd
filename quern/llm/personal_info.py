"""Problem 3: personal information inside free text.

Addresses of mail and place, telephone and identity numbers are recognised by their shape. Names have no
shape of their own; how strongly a word reveals one is estimated from the corpus: the information, in
bits, that the word gives about standing in a name, from how often it stands where texts introduce names
and how often it occurs at all. Runs of words above the disclosure threshold are names, wherever they
stand; a capitalised name that a cue phrase introduces is one whatever its words tell. Words of street names are
learned in the same way from where texts name a street, and disclose a house number that stands before them without
a word for street. Each mention is generalised to a placeholder of its type.

Edge cases, all covered by tests: null and empty texts mention nothing and stay; disguised characters
are read in their plain form; several mentions of a type give one row; rows with equal id count once;
texts of any length are read whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.visual_forms import SUSPECT, plain_form
from quern.session import cut_lineage

# Phrases that introduce a name, with and without accents.
CUES = (
    "tên là", "tên em là", "tên mình là", "tên tôi là", "họ tên:", "họ tên", "họ và tên:", "họ và tên", "ký tên", "đứng tên", "người nộp là", "người nộp:", "người gửi:", "người liên hệ:",
    "chuyển cho cô", "chuyển cho thầy", "của cháu", "phụ trách là cô", "phụ trách là thầy", "nhà cô", "nhà thầy", "ten la", "ho ten:", "ky ten", "dung ten",
    "my name is", "name is", "full name:", "signed by", "signed,", "on behalf of",
)
# Words for persons that may come before a name; they add to what the name's own words tell.
ADDRESSING = "cô|thầy|anh|chị|bạn|cháu|em|bác|chú|ông|bà|phụ huynh|bé|chỗ|tôi là|mình là|em là|gửi|chào|this is|i am|i'm|dear|for|mr|mrs|ms|dr|contact|ask"
#: Least bits for a word of a name, for the mean of a name that stands alone and for one that is introduced.
WORD_BITS, ALONE_BITS, CUED_BITS = 3.0, 5.5, 3.0
#: Occurrences at the corpus's own rate that smooth each word's share of occurrences in names.
PRIOR_SEEN = 1.0
#: Least bits for each word of a street that stands behind a house number.
STREET_BITS = 3.0
#: So many telling words go to the tasks with the code; beyond it they are joined to the texts instead, with the same result.
CARRIED_WORDS = 50_000
TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}

_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|a còng|a cong|@)\s?[)\]}>]\s?|\s(?:a còng|a cong)\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|chấm|cham|\.)\s?[)\]}>]\s?|\s(?:dot|chấm|cham)\s)"
EMAIL = re.compile(rf"[^\W_](?:[\w.+\-]|{_DOT}(?=[\w]))*{_AT}[^\W_][\w\-]*(?:{_DOT}[^\W\d_][\w\-]*)+", re.I)
_SEP = r"[ .\-]?"
PHONE = re.compile(
    rf"(?<![\w/\-.,])(?:(?:\(\+?84\)|\+84|0084|84|0){_SEP}(?:\(0\))?[3-9]\d{{1,2}}{_SEP}\d{{3}}{_SEP}\d{{3,4}}"
    rf"|(?:\+1{_SEP}|1[ .\-])?\(?[2-9]\d{{2}}\)?[ .\-][2-9]\d{{2}}[ .\-]\d{{4}}"
    r"|\+\d{1,3}[ .\-]?(?:\(?\d{1,4}\)?[ .\-]?){2,5}\d{2,4})(?![\w/]|[ .\-]\d)"
)
_ID_CUE = r"(?:cccd|cmnd|cmtnd|căn cước(?: công dân)?|chứng minh(?: nhân dân| thư)?|hộ chiếu|định danh(?: cá nhân)?|can cuoc|chung minh|ho chieu|dinh danh|passport|id number|identity(?: card| number)?|national id|id card|id no\.?)"
ID_CUED = re.compile(rf"{_ID_CUE}[^\d\n]{{0,18}}?((?<![\w])[A-Z]?\d(?:[ .]?\d){{6,11}})(?![\w]|[ .\-]\d)", re.I)
ID_ALONE = re.compile(r"(?<![\w\-/.])(?:0\d{11}|0\d{2}([ .])\d{3}\1\d{3}\1\d{3})(?![\w\-/]|[ .]\d)")
_NUMBER = r"\d{1,4}[A-Za-z]?(?:/\d{1,4}[A-Za-z]?)*"
_STREET_NAME = r"(?!bưu|dẫn|truyền|link|buu|dan\b|truyen|dây|day\b|kính)[^\W\d_]+(?:\s[^\W\d_]+){0,3}"
ADDRESS = re.compile(
    rf"(?<![\w/\-.,])(?:(?:số nhà|so nha|nhà số|nha so|nhà|nha|số|so)\s)?{_NUMBER},?\s(?:(?:hẻm|ngõ|ngách|kiệt|hem|ngo|ngach|kiet)\s{_NUMBER},?\s){{0,3}}(?:đường|phố|đ\.|đại lộ|duong|pho|dai lo)\s?{_STREET_NAME}"
    rf"|(?<![\w])(?:hẻm|ngõ|ngách|kiệt|hem|ngo|ngach|kiet)\s{_NUMBER},?\s(?:(?:đường|phố|đ\.)\s?)?{_STREET_NAME}",
    re.I,
)
ADDRESS_EN = re.compile(r"(?<![\w/\-.,])\d{1,5}[A-Za-z]?\s(?:[A-Z][\w'’]+\s){1,4}(?:Street|Road|Avenue|Lane|Drive|Court|Way|Boulevard|Square|Close|Terrace|Place|Crescent|St|Rd|Ave|Ln|Dr|Blvd)\b\.?")
_WORD = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
# Words for a street before its name, and words for parts of a town.
_STREET = r"(?:đường|phố|đ\.|đại lộ|duong|pho|dai lo)"
_TOWN_PART = r",?\s(?:phường|quận|huyện|xã|thị trấn|thành phố|phuong|quan|huyen|tp\b|p\.|q\.|ward|district)"
STREET_NAMED = re.compile(rf"(?<!\w){_STREET}\s?({_WORD}(?:\s{_WORD}){{1,3}})", re.I)
HOUSE = re.compile(rf"(?<![\w/\-.,])((?i:số nhà|so nha|nhà số|nha so|nhà|nha|số|so)\s)?({_NUMBER}),?\s({_WORD}(?:\s{_WORD}){{1,3}})")
_IN_TOWN = re.compile(_TOWN_PART, re.I)
_CUE = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(CUES, key=len, reverse=True)))})\s+(?:(?:cô|thầy|anh|chị|bạn|em)\s)?({_WORD}(?:\s{_WORD}){{0,5}})(\s*[.,;:!?)\-–\n]|\s*$|)", re.I)
_ADDRESSED = re.compile(rf"(?<!\w)(?:{ADDRESSING})\s*$", re.I)
_WORDS = re.compile(_WORD)



def _re2(pattern: re.Pattern) -> str:
    """A pattern for RE2, which reads a whole batch at a time. It finds at least the texts that the pattern finds: what RE2
    lacks (looking around, word boundaries, references back) is left out or widened, the classes are those of Python."""
    space = r"\s\x0b\x1c-\x1f\x85\p{Z}"
    text = re.sub(r"\(\?<?[!=](?:\[(?:\\.|[^\]])*\]|\\.|[^()\[])*\)", "", pattern.pattern)
    text = text.replace(r"\b", "").replace(r"\1", "[ .]")
    text = text.replace(r"[^\W\d_]", r"[\p{L}\p{Nl}\p{No}]").replace(r"[^\W_]", r"[\p{L}\p{N}]")
    inside = lambda m: m.group().replace(r"\w", r"\p{L}\p{N}_").replace(r"\s", space).replace(r"\d", r"\p{Nd}")
    text = re.sub(r"\[(?:\\.|[^\]])+\]", inside, text)
    outside = {r"\w": r"[\p{L}\p{N}_]", r"\s": f"[{space}]", r"\d": r"\p{Nd}"}
    parts = re.split(r"(\[(?:\\.|[^\]])+\])", text)
    text = "".join(p if i % 2 else re.sub(r"\\[wsd]", lambda m: outside[m.group()], p) for i, p in enumerate(parts))
    return ("(?i)" if pattern.flags & re.I else "") + text


#: A text in which none of these is found mentions nothing by its shape or after a cue.
SHAPES = (*map(_re2, (EMAIL, PHONE, ID_CUED, ID_ALONE, ADDRESS, ADDRESS_EN, _CUE)), _re2(HOUSE).replace(r"([\p{L}\p{Nl}\p{No}]+", r"([\p{Lu}\p{Lt}\p{Nl}][\p{L}\p{Nl}\p{No}]*"))
_CUE_RE2, _STREET_RE2 = _re2(_CUE), _re2(STREET_NAMED)
_SUSPECT_RE2 = re.sub(r"\\u([0-9A-F]{4})", lambda m: rf"\x{{{m.group(1)}}}", SUSPECT)


def plain_texts(texts: pa.Array) -> pa.Array:
    """Texts in plain form; only those with suspect characters are rewritten."""
    odd = pc.fill_null(pc.match_substring_regex(texts, _SUSPECT_RE2), False)
    if not pc.any(odd).as_py():
        return texts
    return pc.replace_with_mask(texts, odd, pa.array([plain_form(t) for t in texts.filter(odd).to_pylist()], texts.type))


def introduced(text: str) -> Iterator[list[str]]:
    """Word lists of the names that cue phrases introduce and punctuation or capitals delimit."""
    for m in _CUE.finditer(text):
        found = _WORDS.findall(m.group(1))
        n = _capitalised(found)
        if 2 <= n <= 5:
            yield [w.lower() for w in found[:n]]
        elif m.group(2) and 2 <= len(found) <= 4 and not any(w[0].isupper() for w in found):
            yield [w.lower() for w in found]


def street_names(text: str) -> Iterator[list[str]]:
    """Word lists of the streets that a word for street introduces and capitals delimit."""
    for m in STREET_NAMED.finditer(text):
        found = _WORDS.findall(m.group(1))
        if (n := _capitalised(found)) >= 2:
            yield [w.lower() for w in found[:n]]


def _capitalised(words: list[str]) -> int:
    """How many words at the beginning have a capital."""
    return next((i for i, w in enumerate(words) if not w[0].isupper()), len(words))


def _introduced_span(m: re.Match) -> tuple[int, int] | None:
    """Where the capitalised name stands that a match of ``_CUE`` introduces; after a cue in capitals, capitals tell nothing."""
    words = list(_WORDS.finditer(m.group(1)))
    n = _capitalised([w.group() for w in words])
    if not 2 <= n <= 5 or m.string[m.start() : m.start(1)].isupper():
        return None
    return m.start(1), m.start(1) + words[n - 1].end()


# -- what words reveal -----------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a partition: occurrences of each word, those in introduced names, and those in named streets."""
    totals: Counter = Counter()
    named: Counter = Counter()
    streets: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = list(totals)
        columns = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (totals, named, streets))]
        for c in (totals, named, streets):
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "n", "in_names", "in_streets"])

    for b in batches:
        texts = plain_texts(b.column(0).drop_null())
        parts = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}'’\-]+").flatten()
        for c in pc.value_counts(parts).to_pylist():
            if c["values"]:
                totals[c["values"]] += c["counts"]
        for t in texts.filter(pc.match_substring_regex(texts, _CUE_RE2)).to_pylist():
            for words in introduced(t):
                named.update(words)
        for t in texts.filter(pc.match_substring_regex(texts, _STREET_RE2)).to_pylist():
            for words in street_names(t):
                streets.update(words)
        if len(totals) > 500_000:
            yield flush()
    if totals or named or streets:
        totals.update({w: 0 for w in (*named, *streets)})
        yield flush()


def word_statistics(texts: DataFrame) -> DataFrame:
    """``word, n, in_names, in_streets`` over all texts (column ``text``); batches are counted where they lie."""
    counts = ("n", "in_names", "in_streets")
    parts = texts.select("text").mapInArrow(_count_words, "word string, " + ", ".join(f"{c} bigint" for c in counts))
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in counts])


def disclosure(statistics: DataFrame, rate: float, street_rate: float) -> DataFrame:
    """``word, bits, street_bits``: how much a word tells about standing in a name, log2 P(name | word) / P(name), and likewise in a street's name.

    The rates are the shares of words in introduced names and in named streets. A word's share is drawn towards
    them as if the word had been seen ``PRIOR_SEEN`` times more, so one introduction tells much of a rare word
    and little of a common one.
    """

    def bits(within: str, share: float):
        seen = F.least(within, "n") + F.lit(PRIOR_SEEN * share)
        told = F.log2((seen / (F.col("n") + F.lit(PRIOR_SEEN))) / F.lit(share))
        return F.when(F.col(within) > 0, told).otherwise(F.lit(-1.0))

    told = statistics.filter("in_names > 0 or in_streets > 0").select("word", bits("in_names", rate).alias("bits"), bits("in_streets", street_rate).alias("street_bits"))
    return told.filter((F.col("bits") >= WORD_BITS) | (F.col("street_bits") >= STREET_BITS))


# -- mentions in one text --------------------------------------------------------------------------


def _led(text: str, start: int, cued: set[int]) -> bool:
    """Whether a phrase or word for a person introduces what starts here."""
    return start in cued or bool(_ADDRESSED.search(text[max(0, start - 24) : start]))


def _bridges(text: str, tokens: list, j: int) -> bool:
    """Whether a common word is the middle of a capitalised name: between two telling capitalised words."""
    if j + 1 >= len(tokens) or tokens[j + 1][2] < WORD_BITS or text[tokens[j][1] : tokens[j + 1][0]] != " ":
        return False
    return all(tokens[k][3][0].isupper() for k in (j - 1, j, j + 1))


def _name_spans(text: str, bits: dict[str, float]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    tokens = [(m.start(), m.end(), bits.get(m.group().lower(), -1.0), m.group()) for m in _WORDS.finditer(text)]
    cues = list(_CUE.finditer(text))
    cued = {m.start(1) for m in cues}
    i = 0
    while i < len(tokens):
        if tokens[i][2] < WORD_BITS:
            i += 1
            continue
        j = i + 1
        while j < len(tokens) and j - i < 5 and text[tokens[j - 1][1] : tokens[j][0]] == " ":
            if tokens[j][2] < WORD_BITS and not _bridges(text, tokens, j):
                break
            j += 1
        lead, k = False, i
        for back in (1, 2):  # a common word may open a capitalised name that is introduced
            k = i - back
            if k < 0 or not tokens[k][3][0].isupper() or text[tokens[k][1] : tokens[k + 1][0]] != " ":
                break
            if lead := _led(text, tokens[k][0], cued):
                i = k
                break
        run = tokens[i:j]
        start = run[0][0]
        telling = [t[2] for t in run if t[2] >= WORD_BITS]
        mean = sum(telling) / len(telling)
        opened, lead = lead, lead or _led(text, start, cued)
        cased = all(t[3][0].isupper() for t in run)
        if cased and j < len(tokens) and len(run) in (2, 3) and tokens[j][3][0].isupper() and text[tokens[j - 1][1] : tokens[j][0]] == " " and (lead or tokens[j][2] > 0):
            run, j = [*run, tokens[j]], j + 1  # a rare last word of a name
            telling.append(WORD_BITS if lead else 0.0)
        if (len(telling) > 1 or (opened and cased and len(run) > 1)) and mean >= (CUED_BITS if lead else ALONE_BITS) and (cased or lead or mean >= ALONE_BITS + 1):
            out.append((start, run[-1][1]))
        i = j
    for span in filter(None, map(_introduced_span, cues)):
        parts = [x for x in out if x[0] < span[1] and span[0] < x[1]]
        out = [x for x in out if x not in parts] + [(min(x[0] for x in [span, *parts]), max(x[1] for x in [span, *parts]))]
    return sorted(out)


def _house_spans(text: str, streets: dict[str, float]) -> Iterator[tuple[int, int]]:
    """House numbers with a street that no word for street names: its words tell that they are one, or a part of the town follows.

    The number alone could be any; it needs a word for house or number, a letter or stroke, or the part of the town.
    """
    for m in HOUSE.finditer(text):
        words = list(_WORDS.finditer(m.group(3)))
        n = _capitalised([w.group() for w in words])
        telling = next((i for i, w in enumerate(words[:n]) if streets.get(w.group().lower(), -1.0) < STREET_BITS), n)
        for k, tells in ((telling, True), (n, False)):
            if k < 2:
                continue
            end = m.start(3) + words[k - 1].end()
            in_town = bool(_IN_TOWN.match(text, end))
            if in_town or (tells and (m.group(1) or not m.group(2).isdigit())):
                yield m.start(), end
                break


def mentions(text: str, bits: dict[str, float], streets: dict[str, float] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, type) of the mentions in a text, without overlaps, in order."""
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= s or start >= e for s, e, _ in found):
            found.append((start, end, kind))

    for m in EMAIL.finditer(text):
        add(*m.span(), "email")
    for m in ID_CUED.finditer(text):
        digits = sum(c.isdigit() for c in m.group(1))
        if digits in (9, 12) or (m.group(1)[0].isalpha() and digits in (7, 8)):
            add(*m.span(1), "id_number")
    for m in ID_ALONE.finditer(text):
        add(*m.span(), "id_number")
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            add(*m.span(), "phone")
    for pattern in (ADDRESS, ADDRESS_EN):
        for m in pattern.finditer(text):
            add(*m.span(), "address")
    for span in _house_spans(text, streets or {}):
        add(*span, "address")
    for span in _name_spans(text, bits):
        add(*span, "name")
    return sorted(found)


def redact(text: str, bits: dict[str, float], streets: dict[str, float] | None = None) -> str:
    out, at = [], 0
    for start, end, kind in mentions(text, bits, streets):
        out += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join(out) + text[at:]


def letter_runs(words: list[str]) -> pa.Array:
    """The runs of letters that words are made of, lower case."""
    runs = pc.split_pattern_regex(pc.utf8_lower(pa.array(words, pa.string())), r"[^\p{L}]+").flatten()
    return pc.unique(runs.filter(pc.not_equal(runs, "")))


def _holds(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Which texts hold one of the runs of letters; a set look-up, so any number of runs will do."""
    if not len(runs):
        return pa.array([False] * len(texts), pa.bool_())
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+")
    hit = np.concatenate([[0], np.cumsum(np.asarray(pc.is_in(parts.flatten(), value_set=runs)))])
    at = np.asarray(parts.offsets) - parts.offsets[0].as_py()
    return pa.array(hit[at[1:]] > hit[at[:-1]], pa.bool_())


def _candidates(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Which plain texts may mention something: all that do, and some that don't. ``runs`` are those of the name words."""
    hit = _holds(texts, runs)
    for pattern in SHAPES:
        hit = pc.or_(hit, pc.fill_null(pc.match_substring_regex(texts, pattern), False))
    return hit


_KEYS = ("table_name", "row_id")


def _find_batches(bits: dict[str, float], streets: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = letter_runs(list(bits))
        for b in batches:
            texts = plain_texts(b.column("text"))
            hit = _candidates(texts, runs)
            kinds = [sorted({k for *_, k in mentions(t, bits, streets)}) for t in texts.filter(hit).to_pylist()]
            keep = b.filter(hit)
            rows = pa.array([i for i, ks in enumerate(kinds) for _ in ks], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [keep.column("table_name").take(rows), keep.column("row_id").take(rows), pa.array([k for ks in kinds for k in ks], pa.string())], names=[*_KEYS, "pii_type"]
            )

    return run


def _redact_batches(bits: dict[str, float], streets: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = letter_runs(list(bits))
        for b in batches:
            texts = plain_texts(b.column("text"))
            hit = _candidates(texts, runs)
            done = pa.array([redact(t, bits, streets) for t in texts.filter(hit).to_pylist()], texts.type)
            out = pc.replace_with_mask(texts, hit, done) if len(done) else texts
            yield pa.RecordBatch.from_arrays([b.column("table_name"), b.column("row_id"), out], names=[*_KEYS, "text"])

    return run


def _joined_batches(redacting: bool):
    """As above, for rows that carry the telling words they contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = plain_texts(b.column("text"))
            hit = pc.or_(_candidates(plain, letter_runs([])), pc.is_valid(b.column("words"))).to_pylist()
            texts, words = plain.to_pylist(), b.column("words").to_pylist()
            bits, streets = ([{x["word"]: x[kind] for x in ws or () if x[kind] >= least} for ws in words] for kind, least in (("bits", WORD_BITS), ("street_bits", STREET_BITS)))
            keys = list(zip(b.column("table_name").to_pylist(), b.column("row_id").to_pylist()))
            if redacting:
                rows = [(*k, redact(t, w, s) if h and t else t) for h, k, t, w, s in zip(hit, keys, texts, bits, streets)]
            else:
                rows = [(*k, kind) for h, k, t, w, s in zip(hit, keys, texts, bits, streets) if h and t for kind in sorted({x for *_, x in mentions(t, w, s)})]
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[*_KEYS, "text" if redacting else "pii_type"])

    return run


def _plain_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text in plain form, as ``mentions`` reads them."""
    for b in batches:
        words = [list(dict.fromkeys(w.lower() for w in _WORDS.findall(t or ""))) for t in plain_texts(b.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(words, pa.list_(pa.string()))], names=["key", "words"])


def with_words(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows with the telling words they contain in plain form, by a join on words; for lexicons too large to carry.

    ``key`` only brings words to rows: should two texts share one, each gets the words of both, and those that it
    doesn't contain change nothing.
    """
    own = rows.withColumn("key", F.xxhash64("table_name", "row_id", "text"))
    words = own.select("key", "text").mapInArrow(_plain_words, "key bigint, words array<string>").select("key", F.explode("words").alias("word")).join(lexicon, "word")
    packed = words.distinct().groupBy("key").agg(F.collect_set(F.struct("word", "bits", "street_bits")).alias("words"))
    return own.join(packed, "key", "left").select("table_name", "row_id", "text", "words")


def learn(rows: DataFrame) -> DataFrame:
    """Telling words of the corpus: ``word, bits, street_bits``."""
    statistics = cut_lineage(word_statistics(rows))
    n, *within = statistics.agg(F.sum("n"), F.sum("in_names"), F.sum("in_streets")).first()
    return disclosure(statistics, *(max(x or 0, 1) / max(n or 0, 1) for x in within))


def _run(rows: DataFrame, carried, redacting: bool, schema: str, most: int) -> DataFrame:
    lexicon = learn(rows)
    few = lexicon.limit(most + 1).collect()
    if len(few) <= most:
        bits, streets = ({r["word"]: r[kind] for r in few if r[kind] >= least} for kind, least in (("bits", WORD_BITS), ("street_bits", STREET_BITS)))
        return rows.mapInArrow(carried(bits, streets), schema)
    return with_words(rows, lexicon).mapInArrow(_joined_batches(redacting), schema)


def found(rows: DataFrame, carried_words: int = CARRIED_WORDS) -> DataFrame:
    """``table_name, row_id, pii_type``: one row per type that a text mentions."""
    out = _run(rows.filter("row_id is not null and text is not null"), _find_batches, False, "table_name string, row_id bigint, pii_type string", carried_words)
    return out.distinct()


def redacted(rows: DataFrame, carried_words: int = CARRIED_WORDS) -> DataFrame:
    """``table_name, row_id, text`` of all rows, each mention replaced by its placeholder."""
    return _run(rows.select("table_name", "row_id", "text"), _redact_batches, True, "table_name string, row_id bigint, text string", carried_words)


def surprise(share: float, rate: float) -> float:
    """Bits that a word with ``share`` of its occurrences in names gives, at ``rate`` names a word; the definition behind ``disclosure``."""
    return math.log2(share / rate) if share > 0 else -math.inf
