"""Problem 9: text that was decoded with the wrong character encoding.

A text is cut into sentences. Those that hold a sequence which a wrong decoding leaves behind are decoded
anew by every candidate chain of codecs; each candidate is compressed with zstandard dictionaries of the
corpus's languages, and the chain with the least description length, its own cost included, is taken. If
no chain beats the text as it stands, the sentence stays unchanged.

Edge cases, all covered by tests: null, empty and blank texts are sound; rows with equal id count once in
``garbled``; texts of any length are read whole; a replacement character is garbled but can't be restored;
empty tables give empty results; other columns are ignored; texts without label or of rare labels have one
common dictionary, without any text there is none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut_lineage

# Codecs by which UTF-8 is most often read wrongly; c1 codes fill what a codec leaves undefined.
MISREAD = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1258", "cp866", "koi8_r")
# Codecs whose characters are ordinary letters of a language, so that only whole runs of them tell that UTF-8 was read.
RUNS_OF = ("cp874", "gbk", "big5", "cp932", "cp949")
# 8-bit codecs that texts had, and the ones they were read by instead.
LEGACY = (("cp1258", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"))
BOM = "\ufeff"
#: Longest text that takes part in a sample of a language, should one be asked for, so that its bytes are bounded too.
LONGEST_DRAWN = 20_000
#: Bytes of texts that a task trains a dictionary on, how many such dictionaries are trained on to make one, bytes of the
#: pieces that texts are cut into for it, and of the segments that a dictionary is made of.
TRAINED_BYTES, FAN, PIECE, SEGMENT = 8 << 20, 64, 2048, 256
#: Cost in bytes of naming a chain for the first time in a text, for each of its steps, and of using it again.
NAME_COST, STEP_COST, AGAIN_COST = 2.0, 1.0, 0.0
#: Cost in bytes of a character that sound texts of the corpus don't have, of a letter of a script that they don't have,
#: and of a sequence that a wrong decoding would leave.
UNSEEN_COST, SCRIPT_COST, SEQUENCE_COST = 2.0, 8.0, 2.0


@lru_cache(maxsize=None)
def byte_of(codec: str) -> dict[str, int]:
    """Byte of each character a codec decodes to; undefined bytes stand for the control character of their number."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1258":  # some readers know cp1258 by the signs of cp1252 where it has no own
        for b in range(0x80, 0x100):
            c = bytes([b]).decode("cp1252", "ignore")
            if c and c not in out:
                out[c] = b
    return out


def _group(codec: str, low: int, high: int) -> str:
    return "".join(sorted({f"\\u{ord(c):04x}" for c, b in byte_of(codec).items() if low <= b <= high and ord(c) > 0x7F and ord(c) < 0x10000}))


@lru_cache(maxsize=None)
def sequence_pattern(codec: str) -> str:
    """What UTF-8 sequences of more than one byte look like under a codec (also valid in Java)."""
    two, three, four, more = (_group(codec, a, b) for a, b in ((0xC2, 0xDF), (0xE0, 0xEF), (0xF0, 0xF4), (0x80, 0xBF)))
    return f"[{two}][{more}]|[{three}][{more}]{{2}}|[{four}][{more}]{{3}}"


#: Bytes of cp1258 read as cp1252: tone marks as letters of their own after a vowel.
_VOWELS = "aeiouyAEIOUY\\u00e2\\u00ea\\u00f4\\u00c2\\u00ca\\u00d4\\u00fd\\u00dd\\u00f5\\u00d5\\u00e3\\u00c3"
_TONES = f"[{_VOWELS}][\\u00cc\\u00d2\\u00de]|[aeouy\\u00e2\\u00ea\\u00f4\\u00fd\\u00f5\\u00e3][\\u00ec\\u00f2](?![\\u00e0-\\u00ff])|\\u00f0|\\u00d0[a-z\\u00e0-\\u00ff]"
#: Text read as latin-1 or cp1252 that was cp1251: long runs of accented letters.
_RUNS = "[\\u00c0-\\u00ff]{4}"
#: A text without these needs no look.
#: Cyrillic with capitals after small letters: koi8-r read as cp1251, or the reverse.
_INVERTED = "[\\u0430-\\u044f\\u0451][\\u0410-\\u042f\\u0401]{2}"
SUSPECT = "|".join([*(sequence_pattern(c) for c in MISREAD), _TONES, _RUNS, _INVERTED, "[\\ufffd\\u0080-\\u0084\\u0086-\\u009f]"])
_SUSPECT = re.compile(SUSPECT)
#: The same for RE2, which reads a batch at a time; without look-ahead it lets a few more texts through.
_SUSPECT_RE2 = re.sub(r"\\u([0-9a-f]{4})", lambda m: rf"\x{{{m.group(1)}}}", SUSPECT.replace("(?![\\u00e0-\\u00ff])", ""))
#: Letters that UTF-8 becomes when read by one of ``RUNS_OF``; a text with them needs a closer look.
_FOREIGN = "[\\u0e01-\\u0e5b\\u3041-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3\\uff61-\\uff9f]"
_FOREIGN_RE2 = re.sub(r"\\u([0-9a-f]{4})", lambda m: rf"\x{{{m.group(1)}}}", _FOREIGN)
_HAS_FOREIGN, _NOT_ASCII = re.compile(_FOREIGN), re.compile(r"[^\x00-\x7f]+")
_LEGACY_HINT = {("cp1258", "cp1252"): re.compile(_TONES), ("cp1251", "cp1252"): re.compile(_RUNS), ("koi8_r", "cp1251"): re.compile(_INVERTED), ("cp1251", "koi8_r"): re.compile(_INVERTED)}
_SURE = re.compile("[�\x80-\x84\x86-\x9f]")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")


@lru_cache(maxsize=None)
def _sequences(codec: str) -> re.Pattern:
    return re.compile(sequence_pattern(codec))


def undo_utf8(text: str, codec: str) -> str:
    """Read the UTF-8 sequences that a codec left in the text; all else stays."""
    table = byte_of(codec)

    def read(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m.group()

    return _sequences(codec).sub(read, text)


def undo_runs(text: str, codec: str) -> str:
    """Read the runs of characters beyond ASCII whose bytes under a codec are UTF-8 as a whole; one letter of UTF-8 alone proves nothing."""

    def read(m: re.Match) -> str:
        try:
            got = m.group().encode(codec).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m.group()
        return got if len(m.group()) > 1 else m.group()

    return _NOT_ASCII.sub(read, text)


def undo_legacy(text: str, codec: tuple[str, str], hinted_only: bool = False) -> str:
    """Read the bytes behind the characters of one 8-bit codec by another: ``codec`` is (what they were, what they were read by).

    Words that the second doesn't have stay. Of the others either each run of words with a hint in it is
    read, or only the words with a hint.
    """
    table, hint = byte_of(codec[1]), _LEGACY_HINT[codec]

    def read(part: str) -> str:
        if not hint.search(part):
            return part
        try:
            return unicodedata.normalize("NFC", bytes(table[c] if ord(c) > 0x7F else ord(c) for c in part).decode(codec[0]))
        except (KeyError, UnicodeDecodeError):
            return part

    words = re.split(r"(\s+)", text)
    if hinted_only:
        return "".join(map(read, words))
    out, run = [], ""
    for w in words:
        if all(c in table or c <= "\x7f" for c in w):
            run += w
        else:
            out += [read(run), w]
            run = ""
    return "".join([*out, read(run)])


def candidates(text: str) -> dict[tuple[str, ...], str]:
    """Decodings of a text by chains of any length, each different text by a shortest chain.

    The codec that was really used reads the most sequences and shortens the text most, so a chain goes on
    from the shortest texts of a step; a passage read by another codec is then the next step. Every step that
    reads UTF-8 shortens the text, so chains end by themselves. An 8-bit codec is undone at most once, last.
    """
    chain_of: dict[str, tuple[str, ...]] = {text: ()}
    level = [text]
    while level:
        found: list[str] = []
        for t in level:
            if t.isascii():
                continue
            steps = [(a, undo_utf8(t, a)) for a in MISREAD]
            if _HAS_FOREIGN.search(t):
                steps += [(a, undo_runs(t, a)) for a in RUNS_OF]
            for name, u in steps:
                if u not in chain_of:
                    chain_of[u] = (*chain_of[t], name)
                    found.append(u)
        least = min(map(len, found), default=0)
        level = [u for u in found if len(u) == least]
    for codec, hint in _LEGACY_HINT.items():
        for t, chain in [x for x in chain_of.items() if len(x[1]) < 2 and hint.search(x[0])]:
            for kind, hinted_only in (("bytes", False), ("words", True)):
                chain_of.setdefault(undo_legacy(t, codec, hinted_only), (*chain, f"{codec[1]} {kind}", codec[0]))
    return {c: t for t, c in chain_of.items() if c}


@lru_cache(maxsize=1 << 14)
def script_of(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


class DescriptionLength:
    """Bytes of a text under the best of several compression dictionaries, and of spelling out what the corpus's sound texts don't have."""

    def __init__(self, dictionaries: dict[str, bytes], alphabet: frozenset[str] = frozenset(), level: int = 9):
        self.alphabet = alphabet
        self.scripts = {script_of(c) for c in alphabet}
        self.by = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in dictionaries.values() if d]
        self.by = self.by or [zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)]

    def __call__(self, text: str) -> float:
        return self.compressed(text) + self.spelled(text)

    def compressed(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(data)) for c in self.by)

    def spelled(self, text: str) -> float:
        odd = [c for c in text if c > "\x7e" and c not in self.alphabet and c != BOM] if self.alphabet else []
        spelled = sum(SCRIPT_COST if c.isalpha() and script_of(c) not in self.scripts else UNSEEN_COST for c in odd)
        return spelled + SEQUENCE_COST * sum(1 for _ in _SUSPECT.finditer(text))


def _suspicious(text: str) -> bool:
    """Whether the text holds what a wrong decoding leaves, or runs of foreign letters that can be read as UTF-8."""
    return bool(_SUSPECT.search(text)) or (bool(_HAS_FOREIGN.search(text)) and any(undo_runs(text, c) != text for c in RUNS_OF))


def _ways(part: str, length: DescriptionLength) -> list[tuple[float, str | None, str, float]]:
    """(description length, chain, text, cost of naming the chain) of a sentence as it stands and of its decodings that may be shortest.

    One whose spelled-out characters alone cost more than another one does with its name need not be compressed.
    """
    out = [(length(part), None, part, 0.0)]
    best = out[0][0]
    for spelled, chain, t in sorted((length.spelled(t), chain, t) for chain, t in candidates(part).items()):
        if spelled > best:
            break
        name = NAME_COST + STEP_COST * (len(chain) - 1)
        out.append((spelled + length.compressed(t), " > ".join(chain), t, name))
        best = min(best, out[-1][0] + name)
    return out


def restore(text: str, length: DescriptionLength) -> tuple[str, list[str]]:
    """(restored text, chains used). Unchanged with no chains if nothing describes the text shorter."""
    if not _suspicious(text):
        return text, []
    parts, at = [], 0
    for end in [m.end() for m in _SENTENCE.finditer(text)] + [len(text)]:
        parts.append(text[at:end])
        at = end
    choices = {}  # distinct suspect sentences: what they may have been, with lengths
    for part in parts:
        if part not in choices and _suspicious(part):
            choices[part] = _ways(part, length)
    used: list[str] = []
    for final in (False, True):  # the second time all chains of the text are known
        for part, ways in choices.items():
            chosen = min(ways, key=lambda w: w[0] + (AGAIN_COST if w[1] in used else w[3]))
            if chosen[1] and chosen[1] not in used:
                used.append(chosen[1])
            if final:
                choices[part] = chosen
    out = "".join(choices[p][2] if p in choices else p for p in parts)
    really = {c[1] for c in choices.values() if c[1]}
    return out.removeprefix(BOM) if really else out, [u for u in used if u in really]


def train(documents: DataFrame, text: Column, lang: Column, per_language: int | None = None, languages: int = 12, size: int = 32768) -> tuple[dict[str, bytes], frozenset[str]]:
    """Dictionaries of the ``languages`` most frequent labels and, as '', of all other texts; and the alphabet.

    Labels are reduced to their primary subtag. Each distinct text without suspect sequences is trained on, of any
    length; the result doesn't depend on how the rows lie. The second result is the alphabet of all these texts.
    With ``per_language`` the dictionaries are of a sample instead: of so many labelled texts of at most
    ``LONGEST_DRAWN`` characters, first by hash.
    """
    label = F.lower(F.regexp_extract(lang, "^\\s*([A-Za-z]{2,3})", 1))
    rows = documents.select(F.coalesce(label, F.lit("")).alias("lang"), text.alias("text")).filter(F.col("text").rlike("\\S"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy(F.desc("n"), "lang").collect()
    common = [r["lang"] for r in counts if r["lang"]][:languages]
    rows = rows.withColumn("hash", F.xxhash64("text"))
    if per_language is not None:
        return _train_on_sample(rows, common, per_language, size)
    sizes = {"": 0, **dict.fromkeys(common, 0)}
    for r in counts:
        sizes[r["lang"] if r["lang"] in sizes else ""] += r["size"]
    parts = {k: max(1, -(-n // TRAINED_BYTES)) for k, n in sizes.items()}
    kept = "lang string, part bigint, hash bigint, data binary"

    def trained(df: DataFrame, merging: bool) -> DataFrame:
        return df.repartition("lang", "part").sortWithinPartitions("lang", "part", "hash", "data").mapInArrow(_train_parts(size, merging), kept)

    got = cut_lineage(trained(rows.mapInArrow(_sound_texts(parts), kept), False))
    made, n = got.filter("lang is not null"), max(parts.values())
    while n > 1:
        n = -(-n // FAN)
        made = trained(made.withColumn("part", F.floor(F.col("part") / FAN)), True)
    letters = got.filter("lang is null").select(F.col("data").cast("string").alias("c")).distinct().collect()
    return {r["lang"]: bytes(r["data"]) for r in made.orderBy("lang").collect()}, frozenset(r["c"] for r in letters)


def _sound(b: pa.RecordBatch) -> pa.RecordBatch:
    b = b.filter(pc.invert(_suspect(b.column("text"))))
    return b.filter(pa.array([not (f and _suspicious(t)) for f, t in zip(_foreign(b.column("text")).to_pylist(), b.column("text").to_pylist())], pa.bool_()))


def _letters(alphabet: set[str]) -> list[str]:
    """Unusual spaces are no letters, and left by wrong decodings."""
    return [c for c in sorted(alphabet) if c == " " or not c.isspace()]


def _part_rows(rows: list[tuple[str | None, int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["lang", "part", "hash", "data"])


def _sound_texts(parts: dict[str, int]):
    """The sound texts of a partition with the part of their language that trains on them, by hash, and each character as a row without language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet: set[str] = set()
        for b in map(_sound, batches):
            found = set()  # repeats of other batches are left out where they meet
            for lang, text, key in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "hash"))):
                lang = lang if lang in parts else ""
                found.add((lang, key % parts[lang], key, text))
            for row in found:
                alphabet.update(row[3])
            yield _part_rows([(*row[:3], row[3].encode()) for row in found])
        yield _part_rows([(None, ord(c) % 64, 0, c.encode()) for c in _letters(alphabet)])

    return run


def _dictionary(texts: list[bytes], size: int) -> bytes:
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:  # with the parameters named and no share set apart for choosing them, all pieces are trained on
        return zstandard.train_dictionary(size, pieces, k=SEGMENT, d=8, split_point=1.0).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: they are the dictionary
        return b"\n".join(texts)[:size]


def _train_parts(size: int, merging: bool):
    """A dictionary of the distinct texts of each part; when ``merging``, of the dictionaries of some parts. Rows come sorted; those without language are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts = None, []

        def made() -> pa.RecordBatch:
            data = texts[0] if merging and len(texts) == 1 else _dictionary(texts, size)
            return _part_rows([(*at, at[1], data)])

        for b in batches:
            passed = set()
            for lang, part, data in zip(*(b.column(c).to_pylist() for c in ("lang", "part", "data"))):
                if lang is None:
                    passed.add((lang, part, 0, data))
                    continue
                if (lang, part) != at:
                    if texts:
                        yield made()
                    at, texts = (lang, part), []
                if not texts or texts[-1] != data:
                    texts.append(data)
            yield _part_rows(list(passed))
        if texts:
            yield made()

    return run


def _train_on_sample(rows: DataFrame, common: list[str], per_language: int, size: int) -> tuple[dict[str, bytes], frozenset[str]]:
    parts = rows.mapInArrow(_sound_parts(common, per_language), "lang string, text string, hash bigint").distinct()
    first = Window.partitionBy("lang").orderBy("hash", "text")
    got = parts.withColumn("n", F.row_number().over(first)).filter((F.col("lang") == "") | (F.col("n") <= per_language)).select("lang", "text").collect()
    sample = [r for r in got if r["lang"]]
    by: dict[str, list[bytes]] = {}
    for r in sample:
        by.setdefault(r["lang"], []).append(r["text"].encode())
    out = {}
    for name in sorted(by):
        texts = by[name]
        try:
            out[name] = zstandard.train_dictionary(size, texts).as_bytes()
        except zstandard.ZstdError:  # too few texts to train on: they are the dictionary
            out[name] = b"\n".join(texts)[:size]
    return out, frozenset(r["text"] for r in got if not r["lang"])


def _suspect(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(texts, _SUSPECT_RE2), False)


def _foreign(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(texts, _FOREIGN_RE2), False)


def _sound_parts(languages: list[str], most: int):
    """Of the sound texts of a partition: each character as a row without label, and of each language ``most`` distinct texts, first by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet: set[str] = set()
        drawn: dict[str, set[tuple[int, str]]] = {x: set() for x in languages}
        last = dict.fromkeys(languages, 1 << 63)
        for b in map(_sound, batches):
            for lang, text, key in zip(*(b.column(c).to_pylist() for c in ("lang", "text", "hash"))):
                alphabet.update(text)
                if lang in drawn and key <= last[lang] and len(text) <= LONGEST_DRAWN:
                    own = drawn[lang]
                    own.add((key, text))
                    if len(own) >= 2 * most:
                        drawn[lang] = own = set(sorted(own)[:most])
                        last[lang] = max(own)[0]
        rows = [("", c, 0) for c in _letters(alphabet)]
        rows += [(lang, text, key) for lang, own in drawn.items() for key, text in sorted(own)[:most]]
        for i in range(0, len(rows), 1000):
            some = zip(*rows[i : i + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(some, (pa.string(), pa.string(), pa.int64()))], names=["lang", "text", "hash"])

    return run


def _restore_batches(dictionaries: dict[str, bytes], alphabet: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = DescriptionLength(dictionaries, alphabet)
        for b in batches:
            b = b.filter(pc.or_(_suspect(b.column("text")), _foreign(b.column("text"))))
            texts = b.column("text").to_pylist()
            got = [restore(t, length) for t in texts]
            garbled = [bool(used or _SURE.search(t)) for t, (_, used) in zip(texts, got)]
            whole = [not _SURE.search(r) for r, _ in got]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r for r, _ in got], pa.string()), pa.array([u for _, u in got], pa.list_(pa.string())), pa.array(garbled, pa.bool_()), pa.array(whole, pa.bool_())],
                names=["doc_id", "restored", "chains", "garbled", "whole"],
            )

    return run


def restored(documents: DataFrame, did: Column, text: Column, lang: Column) -> DataFrame:
    """``doc_id, restored, chains, garbled, whole`` of the texts with suspect sequences; all others are sound as they are.

    ``whole`` tells whether nothing is left that can't be restored.
    """
    dictionaries, alphabet = train(documents, text, lang)
    rows = documents.select(did.cast("bigint").alias("doc_id"), text.alias("text")).filter("text is not null")
    return rows.mapInArrow(_restore_batches(dictionaries, alphabet), "doc_id bigint, restored string, chains array<string>, garbled boolean, whole boolean")


def garbled(documents: DataFrame, did: Column, text: Column, lang: Column) -> DataFrame:
    """``doc_id`` of the documents with garbled characters anywhere."""
    return restored(documents, did, text, lang).filter("garbled and doc_id is not null").select("doc_id").distinct()
