"""Problem 2: texts that look alike but are made of different characters.

The skeleton of a text is made by decomposing it, replacing every character by its prototype and
decomposing again; texts with equal skeletons look alike and form a group. Prototypes are those of the Unicode
confusables list, which the library that Spark's collations come with holds. The plain form is what the
text is brought to: like the skeleton it has ordinary characters only, but it leaves alone what is no
disguise (words of another script, single symbols, typographic quotes and dashes, emoji).

Edge cases, all covered by tests: null has neither plain form nor skeleton; the empty text is plain;
blank texts of unusual spaces become ordinary spaces; texts of any length are read whole; rows with
equal id count once in ``disguised``; empty tables give empty results; other columns are kept apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other alphabets that look like Latin ones, and the Latin letters they look like. They hold
# where no Spark session gives the whole list, and before it where both have a letter.
_LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТУХԌԚԜҮӀ", "ABESIJKMHOPCTYXGQWYI"),  # Cyrillic capitals
    ("аеѕіјорсухԁһԛԝүӏґк", "aesijopcyxdhqwylrk"),  # Cyrillic small letters
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),  # Greek capitals
    ("αικνορυχγϲϳ", "aikvopuxycj"),  # Greek small letters
    ("օոսհցՕՍԼ", "onuhgOUL"),  # Armenian
    ("ɑɡɩʀꞵ", "agiRb"),  # phonetic letters
    ("ÐƉ", "ĐĐ"),  # other Latin alphabets' letters for Vietnamese Đ
)
PROTOTYPES = {a: b for odd, plain in _LOOKALIKES for a, b in zip(odd, plain, strict=True)}
# Kinds of compatibility decomposition whose characters are styled forms of ordinary ones.
_STYLES = ("<font>", "<wide>", "<narrow>", "<circle>", "<small>", "<square>", "<noBreak>")
# Characters of no width that Unicode does not class as format characters.
_UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

# Prototypes of ASCII characters in the confusables list.
ASCII_PROTOTYPES = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn"}
_ASCII_TABLE = str.maketrans(ASCII_PROTOTYPES)
# Alphabets of whose letters any stands out within a Latin word, with a known prototype or without.
_ALPHABETS = ("CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE", "GEORGIAN", "GLAGOLITIC", "GOTHIC", "DESERET", "HEBREW")
# Letters that tell a Turkic text, where the dotless i is ordinary.
_TURKIC = frozenset("ğşİĞŞ")

#: A text of these characters alone, nothing combining, is its own plain form, and its skeleton differs by ASCII prototypes only.
SUSPECT = "[^\\t\\n\\r\\x20-\\x7E\\u00A1-\\u00A9\\u00AB\\u00AC\\u00AE-\\u00CF\\u00D1-\\u0130\\u0132-\\u017E\\u0180-\\u0188\\u018A-\\u01C3\\u01CD-\\u01F0\\u01F4-\\u0250\\u1E00-\\u1E99\\u1EA0-\\u1EF9\\u2010\\u2012-\\u2027\\u2030-\\u205E\\u20A0-\\u20BF]"
_WORD = re.compile(r"(?:[^\W\d_]|[̀-ͯ])+")
_EMOJI_JOIN = "‍"


@lru_cache(maxsize=1 << 16)
def _unstyled(c: str) -> str:
    how = unicodedata.decomposition(c)
    if how.startswith(_STYLES) or (how.startswith("<compat>") and c > "ž" and unicodedata.category(c).startswith("L")):
        return unicodedata.normalize("NFKC", c)
    return c


@lru_cache(maxsize=1 << 16)
def _alphabet(c: str) -> str:
    """First word of the letter's name; LATIN for all letters below the phonetic ones and for marks of letters."""
    return "LATIN" if c < "\u0250" or unicodedata.category(c) == "Lm" else unicodedata.name(c, "?").split(" ")[0]


def _is_emoji(c: str) -> bool:
    return unicodedata.category(c) == "So" or "\U0001f3fb" <= c <= "\U0001f3ff"


def confusables(spark: SparkSession) -> dict[str, str]:
    """Prototypes of all letters and digits beyond ASCII that have another than themselves, from the confusables list in one call.

    Ideographs and syllables that are composed by rule are left out: none looks like a letter.
    """
    skip = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0x17000, 0x18D08), (0x1B000, 0x1B2FF))
    odd = re.compile(SUSPECT)  # letters that this passes over are ordinary
    there = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c)[0] in "LN" and odd.search(c) and not any(a <= ord(c) <= b for a, b in skip)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    bones = checker.getSkeleton("\n".join(there)).split("\n")
    return {c: b for c, b in zip(there, bones, strict=True) if b != unicodedata.normalize("NFD", c)}


def latin_look_alikes(prototypes: dict[str, str]) -> dict[str, str]:
    """The Latin letter that each letter of another alphabet looks like, also by way of a small capital, in its own case."""
    out = {}
    for c in [*prototypes, *map(chr, range(0x250, 0x2B0)), *map(chr, range(0x1D00, 0x1D80))]:
        if not unicodedata.category(c).startswith("L") or (c < "\u0250" and c != "ı"):
            continue
        p = prototypes.get(c, c)
        if m := re.match(r"LATIN LETTER SMALL CAPITAL ([A-Z])$", unicodedata.name(p, "") if len(p) == 1 else ""):
            p = m.group(1).lower()
        if len(p) == 1 and p.isascii() and p.isalpha():
            out[c] = "I" if p == "l" and c.isupper() else p
    return out


class Forms:
    """Plain forms and skeletons under a table of prototypes (that of ``confusables``, or the fixed values alone)."""

    def __init__(self, prototypes: dict[str, str] | None = None):
        self.letters = latin_look_alikes(prototypes or {}) | PROTOTYPES
        self.bones = (prototypes or {}) | PROTOTYPES
        self.seen: dict[str, str] = {}
        self.mixed = False

    def prototype(self, c: str) -> str:
        """The characters that ``c`` looks like in the list; ``c`` itself if it is ordinary, '' if it is not seen."""
        if (p := self.seen.get(c)) is None:
            p = self.seen[c] = self.bones[c] if c in self.bones else ordinary(c)
        return p

    def skeleton(self, text: str) -> str:
        """Decompose, replace every character by its prototype, compose, and replace ASCII characters by theirs.

        Those come last and on composed letters, so that texts without suspect characters get theirs in the JVM.
        """
        bones = unicodedata.normalize("NFC", "".join(map(self.prototype, unicodedata.normalize("NFD", text))))
        return bones.translate(_ASCII_TABLE)

    def _plain_word(self, m: re.Match) -> str:
        word = m.group()
        if word.isascii():
            return word
        letters = unicodedata.normalize("NFD", word)  # a look-alike may have been composed with an accent
        bases = [c for c in letters if c.isalpha()]
        foreign = [c for c in bases if _alphabet(c) != "LATIN"]
        other = [c for c in foreign if c in self.letters or _alphabet(c) in _ALPHABETS]
        if len(foreign) == len(bases) or any(c in "þðæÞÆ" for c in bases) or not (other or any(c in self.letters for c in letters)):
            return word
        if len(bases) <= 3 and any(c not in self.letters and _alphabet(c) == "GREEK" for c in other):  # a unit or a formula
            return word
        self.mixed |= bool(other)
        return unicodedata.normalize("NFC", "".join(self.letters.get(c, c) for c in letters))

    def plain(self, text: str) -> tuple[str, bool]:
        """The text in ordinary characters, and whether something in it is a disguise. Without one the text stays exactly.

        A letter of another alphabet within a Latin word is a disguise even if no Latin letter looks like it; it then stays.
        """
        out: list[str] = []
        for i, c in enumerate(text):
            if c.isascii():
                out.append(" " if c in "\x0b\x0c" else c)
            elif c == _EMOJI_JOIN or c == "️":
                joins = i > 0 and (_is_emoji(text[i - 1]) or text[i - 1] == "️") and (c == "️" or (i + 1 < len(text) and _is_emoji(text[i + 1])))
                out.append(c if joins else "")
            else:
                out.append(_unstyled(c) if c in self.letters else ordinary(c))
        composed = unicodedata.normalize("NFC", "".join(out))
        self.mixed = False
        dotless = "ı" in composed and not _TURKIC.isdisjoint(composed)
        kept = composed.replace("ı", "\ue000") if dotless else composed
        kept = unicodedata.normalize("NFC", _WORD.sub(self._plain_word, kept))
        got = kept.replace("\ue000", "ı") if dotless else kept
        return got, got != text or self.mixed


@lru_cache(maxsize=1 << 16)
def ordinary(c: str) -> str:
    """What a character stands in for by itself: a styled form, an unusual space, or nothing if it is not seen."""
    if c in "\t\n\r ":
        return c
    category = unicodedata.category(c)
    if category == "Cf" or c in _UNSEEN or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if category in ("Zs", "Zl", "Zp") or c in "\x0b\x0c\x85":
        return " "
    return _unstyled(c)


_FIXED = Forms()


def skeleton(text: str) -> str:
    return _FIXED.skeleton(text)


def plain_form(text: str) -> str:
    """The text in ordinary characters, by the fixed look-alikes alone. It equals the text exactly if nothing in the text is a disguise."""
    return _FIXED.plain(text)[0]


def _forms(prototypes: dict[str, str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Forms(prototypes)
        for b in batches:
            plain = [f.plain(t) for t in b["text"]]
            bones = [f.skeleton(t) for t in b["text"]]
            yield b.assign(plain=[p for p, _ in plain], skeleton=bones, disguise=[d for _, d in plain])

    return run


_COLUMNS = ["table_name", "row_id", "field_name", "text"]
_FORMS = "table_name string, row_id bigint, field_name string, text string, plain string, skeleton string, disguise boolean"


def _odd_forms(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("text").rlike(SUSPECT)).select(*_COLUMNS).mapInPandas(_forms(confusables(rows.sparkSession)), _FORMS)


def forms(rows: DataFrame) -> DataFrame:
    """``table_name, row_id, field_name, text`` with ``plain``, ``skeleton`` (composed for storing) and ``disguise``.

    Only texts with a suspect character leave the JVM; of all others the plain form is the text.
    """
    bones = F.col("text")
    for c, p in ASCII_PROTOTYPES.items():
        bones = F.replace(bones, F.lit(c), F.lit(p))
    even = rows.filter(~F.coalesce(F.col("text").rlike(SUSPECT), F.lit(False))).select(*_COLUMNS, F.col("text").alias("plain"), bones.alias("skeleton"), F.lit(False).alias("disguise"))
    return even.unionByName(_odd_forms(rows))


def disguised(rows: DataFrame) -> DataFrame:
    """``table_name, row_id, field_name`` of the texts that a disguise keeps from being ordinary: their characters aren't those of their skeleton, and the plain form differs or letters of two alphabets share a word."""
    return _odd_forms(rows).filter("skeleton <> text and disguise").select("table_name", "row_id", "field_name").distinct()


def look_alikes(rows: DataFrame) -> DataFrame:
    """``skeleton, texts, rows, example``: groups of different texts with one skeleton.

    Counts are pre-aggregated over exact copies, so a group with a third of all rows moves as one row for
    each different text and task.
    """
    texts = forms(rows).filter("text is not null").groupBy("skeleton", "text").agg(F.count("*").alias("n"))
    groups = texts.groupBy("skeleton").agg(F.count("*").alias("texts"), F.sum("n").alias("rows"), F.min("text").alias("example"))
    return groups.filter("texts > 1")


def text_rows(parts: list[tuple[str, DataFrame, Column, str]]) -> DataFrame:
    """``table_name, row_id, field_name, text`` of the named columns: (table, its rows, id column, text column)."""
    out = None
    for table, df, rid, field in parts:
        part = df.select(F.lit(table).alias("table_name"), rid.cast("bigint").alias("row_id"), F.lit(field).alias("field_name"), F.col(f"`{field}`").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out
