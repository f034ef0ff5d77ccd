"""Problem 6: broken pairs of prompt and response.

Copied responses are measured by traversing the suffix automaton of the prompt's words: it gives, for
every word of the response, the longest run ending there that the prompt contains. Refusals are found by
automata, one of refusal phrases and some of how sentences decline (a negation with a word for answering), cut-off answers by a stack of open brackets and marks and by how the
last line ends, and answers in another language by votes of stopwords and scripts.

A pair has at most one defect: the first that holds of empty, refusal, copies_question, other_language,
truncated.

Edge cases, all covered by tests: a null, empty or blank response is empty; a null or wordless prompt
can't be copied and has no language; rows with equal id are one pair; texts of any length are read whole;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answers that stand for nothing, folded.
PLACEHOLDERS = {"none", "null", "na", "n a", "nan", "nil", "undefined", "empty", "blank", "trong", "tbd", "void", "no answer", "khong co", "chua co"}
# Phrases that decline or say that nothing can be said, folded.
REFUSALS = (
    "khong the tra loi", "khong tra loi duoc", "khong the giai dap", "xin phep khong tra loi", "tu choi", "khong ho tro", "khong the ho tro", "khong the giup", "khong giup duoc",
    "khong the cung cap", "khong cung cap duoc", "khong co thong tin", "chua co thong tin", "khong co du lieu", "chua co du lieu", "khong tim thay", "khong tim duoc", "khong tra duoc",
    "khong tra cuu duoc", "nam ngoai pham vi", "ngoai pham vi", "nam ngoai kha nang", "ngoai kha nang", "khong the duoc xu ly", "khong the xu ly", "khong xu ly duoc", "khong binh luan",
    "bo qua cau hoi", "chua du can cu", "khong du can cu", "khong duoc phep", "minh chiu", "toi chiu", "khong co cau tra loi", "khong co ban ghi nao", "khong the thuc hien", "khong biet",
    "must decline", "have to decline", "decline to", "to be declined", "i decline", "unable to", "not able to", "cannot answer", "can t answer", "cannot help", "can t help", "cannot provide", "can t provide",
    "cannot assist", "can t assist", "rather not", "no matching information", "don t have any information", "do not have any information", "don t have information", "do not have information", "no information",
    "have no data", "have no information", "no data on", "don t have data", "do not have data", "not permitted to", "not allowed to", "cannot comment", "can t comment", "no comment", "outside my", "outside of my",
    "outside the scope", "beyond my", "beyond the scope", "cannot be processed", "could not be processed", "could not find", "couldn t find", "cannot discuss", "can t discuss", "not supported", "i do not know", "i don t know",
    "khong co noi dung khop", "chua duoc phep", "chua the tra loi", "chua tra loi duoc", "khong co muc nao", "khong co ket qua", "chua tim thay", "khong co noi dung nao", "khong nam trong", "chua the ho tro",
    "outside what i", "not possible for me", "it is not possible to", "no record matches", "nothing i can tell", "no matching record", "no record was found",
    "will skip this", "have to skip", "have to pass on", "not enough grounds", "not enough information", "not enough basis",
)
# Who speaks in a refusal that could also be said of others, folded.
_SPEAKERS = re.compile(r"\b(?:toi|minh|tro ly|em|chung toi|he thong|i|me|we|assistant|system|request|question|yeu cau|cau hoi|ban ghi|thong tin|information|noi dung|this|phan nay|answer)\b")
# How sentences decline beyond the phrases above, folded: a negation, few words, a word for answering.
_DECLINES = re.compile(
    r"\b(?:khong|chua|chang|ko|chiu khong|ngung|tam dung)(?: \w+){0,3} (?:tra loi|giai dap|cung cap|ho tro|giup|tu van|dap ung|phan hoi|ban luan|binh luan|thao luan|de cap|noi|tiet lo|chia se|xu ly|dua ra)\b"
    r"|\b(?:vuot|vuot qua|vuot ngoai|ngoai|khong thuoc|khong nam trong)(?: \w+){0,1} (?:pham vi|kha nang|tham quyen|quyen han|linh vuc|chuc nang|nhiem vu)\b"
    r"|\b(?:xin|danh|dau) (?:\w+ ){0,3}(?:de ngo|bo qua|bo trong|kieu|tu choi|khat)\b|\bde (?:\w+ ){0,4}(?:bo ngo|khong tra loi)\b"
    r"|\b(?:cannot|can t|can not|could not|couldn t|won t|will not|would not|wouldn t|unable to|not able to|refuse to|refusing to|declin\w+ to|must not|may not|not going to|prefer not to|not in a position to|not free to|not allowed to|not authori[sz]ed to|do not|don t|am not)"
    r"(?: \w+){0,3} (?:answer|answering|respond|reply|help|assist|provide|discuss|comment|tell|say|address|share|give|offer|advise)\b"
    r"|\b(?:leave|leaving|left|stay|stays|remain|remains|go|goes)(?: \w+){0,4} unanswered\b|\bno (?:answer|reply|response|comment)\b|\b(?:outside|beyond|out of)(?: \w+){0,2} (?:scope|remit|area|reach|knowledge|abilities|ability|powers|authority)\b"
    r"|\b(?:nothing|not anything|not something)(?: \w+){0,3} (?:i|we) (?:can|could|may|am able to|am allowed to|are able to)\b|\b(?:against|violates?)(?: \w+){0,3} (?:rules|policy|guidelines)\b"
)
# Sentences that close a refusal without adding anything, folded.
_CLOSING = re.compile(
    r"^(?:(?:da |vang )?(?:rat )?(?:cam on|xin cam on|xin loi|rat tiec|tiec qua|mong ban|thanh that|hy vong)\b|(?:ban )?(?:vui long|xin vui long|hay|co the)\b.*\b(?:lien he|hoi|cau hoi khac|thu lai|gap|quay lai|dat cau hoi)\b"
    r"|(?:please|kindly|you may|you can)\b.*\b(?:ask|contact|try|reach|another question|rephrase|call|visit)\b|(?:thank|thanks|sorry|apologies|i m sorry|i am sorry)\b)"
)
# Offers to search.
_OFFER = re.compile(r"\b(?:tra cuu|tim truc tuyen|tim tren mang|tren mang|tim kiem|tim giup|tra giup|tim them|search|look it up|look up|online|web)\b")
# Words that make a sentence a question, with accents and as typed without.
_ASKING = frozenset("bao nhiêu mấy gì nào đâu không chưa sao ai nhỉ hả what when where how which who why can could is are do does may should will has have".split())
_ASKING_PLAIN = frozenset("bao nhieu may gi nao dau khong chua sao ai nhi ha what when where how which who why can could is are do does may should will has have".split())
# Frequent words of some languages, folded as in ``words`` but with their accents.
STOPWORDS = {
    "vi": "là của và có được không các cho với trong này khi tại từ đến những một người để theo thì đã bạn phải mình em cần hoặc qua trước sau như rất nếu vì sẽ còn rồi đó nào gì ở do về trên dưới vào ra lại cũng mà nên hay bị bởi đang vẫn mỗi nhiều ai sao đâu bao nhiêu hết lúc ngày năm giờ",
    "vi_plain": "la cua va co duoc khong cac cho voi trong nay khi tai tu den nhung mot nguoi de theo thi da ban phai minh em can hoac qua truoc sau nhu rat neu vi se con roi do nao gi o ve tren duoi vao ra lai cung ma nen hay bi boi dang van moi nhieu ai sao dau bao nhieu het luc ngay nam gio lam mat hoi lau xin cau",
    "en": "the of and to in is you for that it with on are be this as have or your from by an at not which we can will if may must do does what how where when there has was",
    "fr": "le la les des est et une du pour dans que vous sur au avec ce par plus pas sont votre aux ou cette d l il elle nous qui",
    "es": "el los las de y una para por con su se del al es en que lo como más está son debe sus o un le usted",
    "pt": "o os as de e uma para por com seu sua se do da no na em que um não é ao dos das pela pelo você deve são",
    "id": "yang dan di ke dari untuk dengan pada ini itu tidak akan atau dalam oleh setiap sekali adalah anda harus dapat bisa silakan sudah belum kami para",
    "de": "der die das und ist nicht ein eine für mit auf den dem zu im von sie werden sind bei oder nach muss wird",
}
STOPWORDS = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
_LANGUAGES_OF = {w: [k for k, v in STOPWORDS.items() if w in v] for w in frozenset().union(*STOPWORDS.values())}
_SCRIPTS = (("zh", re.compile("[㐀-鿿豈-﫿]")), ("ja", re.compile("[぀-ヿ]")), ("ko", re.compile("[가-힯]")), ("ru", re.compile("[Ѐ-ӿ]")), ("th", re.compile("[฀-๿]")), ("ar", re.compile("[؀-ۿ]")))
_ANY_SCRIPT = re.compile("[" + "".join(p.pattern[1:-1] for _, p in _SCRIPTS) + "]")
_VIETNAMESE = re.compile("[ăâđêôơưĂÂĐÊÔƠƯạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủũứừửữựỳỵỷỹĩ]")

_WORDS = re.compile(r"\w+")
_VIETNAMESE_WORDS = re.compile(rf"\w*{_VIETNAMESE.pattern}\w*")
_SENTENCES = re.compile(r"(?<=[.!?…。！？])(?:[\"”»’)]*)\s+|\n+")
_BRACKETS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "）": "（"}
_ITEM = re.compile(r"^\s*(?:[-*•+–]|\(?\d{1,3}[.)]|[a-z][.)])\s+(.*)$")
# Words that never end a sentence.
_DANGLING = frozenset(
    "và hoặc là của cho với tại từ đến để theo thì các những một mỗi như mà nếu khi do bởi về vào trên dưới qua bằng không được phải cần sẽ đang ở bạn nộp trong the a an of and or to in is for with on are at by from as that your if than but into about which will must".split()
)
# Words before the letter of a place, folded.
_PLACES = frozenset("phong nha sanh khu tang lop toa block room hall khoi day cong building gate class nhom hang loai diem to bang".split())
_SYLLABLE = re.compile(r"(?:ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|[bcdghklmnpqrstvx])?[aeiouy]{1,3}(?:ch|ng|nh|[cmnpt])?$")


_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")


def fold(text: str) -> str:
    """Lower case without accents, compatibility forms and invisible characters."""
    if text.isascii():
        return text.casefold()
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.replace("Đ", "D").replace("đ", "d"))).casefold()


def words(text: str) -> list[str]:
    return _WORDS.findall(fold(text))


def asking(text: str, folded: list[str]) -> list[bool]:
    """Which words make a question; in a text with accents, by their accented spelling."""
    raw = _WORDS.findall(unicodedata.normalize("NFKC", text).casefold())
    if len(raw) != len(folded) or raw == folded:
        return [w in _ASKING_PLAIN for w in folded]
    return [w in _ASKING for w in raw]


_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]*\"")


class SuffixAutomaton:
    """Suffix automaton of a sequence of words."""

    def __init__(self, sequence: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in sequence:
            cur = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.link[cur] = 0
            elif self.length[q := self.next[p][w]] == self.length[p] + 1:
                self.link[cur] = q
            else:
                clone = self._state(dict(self.next[q]), self.length[p] + 1)
                self.link[clone], self.link[q], self.link[cur] = self.link[q], clone, clone
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = clone
                    p = self.link[p]
            last = cur

    def _state(self, edges: dict[str, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def runs(self, sequence: list[str]) -> list[int]:
        """For each word, the length of the longest run ending there that occurs in the automaton's sequence."""
        state, n, out = 0, 0, []
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def covered(runs: list[int], least: int) -> list[bool]:
    """Which words lie in a run of at least ``least`` copied words."""
    out, until = [False] * len(runs), len(runs)
    for i in range(len(runs) - 1, -1, -1):
        if runs[i] >= least:
            until = min(until, i - runs[i] + 1)
        if i >= until:
            out[i] = True
        if i == until:
            until = len(runs)
    return out


def copies(prompt: str, response: str, least: int = 2, share: float = 0.7) -> bool:
    """Whether the response only repeats the prompt.

    Each of its sentences must be covered by copied runs: a sentence that asks to ``share``, any other
    wholly (but for one word). What comes before a colon or quotation mark is a lead-in.
    """
    asked = words(prompt)
    if not asked:
        return False
    there = set(asked)
    automaton, copied, any_asks, k = None, 0, False, -1
    wants = any(asking(prompt, asked))
    for sentence in _SENTENCES.split(response):
        if not (said := words(sentence)):
            continue
        k += 1
        if k and sum(w in there for w in said) < 0.5 * len(said):  # more than half of its words are new
            return False
        automaton = automaton or SuffixAutomaton(asked)
        asks_at = asking(sentence, said)
        hit = covered(automaton.runs(said), min(least, len(asked)))
        if k == 0 and (m := re.match(r"^[^:“\"«]*[:“\"«]\s*", sentence)) and 0 < (lead := len(words(m.group()))) < len(said) and not any(hit[:lead][:2]):
            said, hit = said[lead:], hit[lead:]
            asks_at = asking(sentence[m.end() :], said)
        n = sum(hit)
        asks = any(q and h for q, h in zip(asks_at, hit))
        new_number = any(not h and any(c.isdigit() for c in w) and w not in asked for w, h in zip(said, hit))
        if new_number or n < (len(said) * share if asks else max(len(said) - 1, 0.9 * len(said))):
            return False
        copied, any_asks = copied + n, any_asks or asks
    need = 0.4 if any_asks else 0.85
    return k >= 0 and copied >= min(len(asked), max(3, need * min(len(asked), 14))) and (any_asks or not wants)


@lru_cache(maxsize=1)
def _refusal_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(f" {p} ", p)
    a.make_automaton()
    return a


def _declines(said: str, prompt: str) -> bool:
    """Whether a sentence declines in words that the prompt lacks: a question that is repeated may have the like of its own."""
    m = _DECLINES.search(said)
    return bool(m) and m.group() not in " ".join(words(prompt))


def refuses(response: str, prompt: str = "") -> bool:
    """Whether the response declines and says nothing else. A question back or an offer to search is no refusal.

    A sentence with a number that the prompt lacks informs, one that only repeats the prompt's doesn't.
    """
    seen, asked = False, None
    for sentence in _SENTENCES.split(response):
        said = " ".join(words(_QUOTED.sub(" ", sentence)))
        if not said and not words(sentence):
            continue
        if sentence.rstrip().rstrip("\"”»").endswith(("?", "？")) or (_OFFER.search(said) and re.search(r"\b(?:dong y|co muon|shall i|may i|would you like|do you want|neu ban|if you)\b", said)):
            return False
        if (any(True for _ in _refusal_automaton().iter(f" {said} ")) or _declines(said, prompt)) and _SPEAKERS.search(said):
            if numbers := [w for w in said.split() if any(c.isdigit() for c in w)]:
                asked = set(words(prompt)) if asked is None else asked
                if not asked.issuperset(numbers):
                    return False
            seen = True
        elif not _CLOSING.match(said):
            return False
    return seen


def language_votes(text: str) -> Counter:
    """Votes for languages: stopwords by occurrence, and letters of scripts that only few languages use."""
    votes: Counter = Counter()
    composed = unicodedata.normalize("NFKC", text)
    for lang, script in _SCRIPTS if not composed.isascii() and _ANY_SCRIPT.search(composed) else ():
        if n := len(script.findall(composed)):
            votes[lang] += n if lang in ("zh", "ja", "th") else len(re.findall(script.pattern + "+", composed))
    folded = composed.casefold()
    accented = 0 if composed.isascii() else len(_VIETNAMESE_WORDS.findall(folded))
    tokens = _WORDS.findall(folded)
    for w in tokens:
        if w in _LANGUAGES_OF:
            for lang in _LANGUAGES_OF[w]:
                votes[lang] += 1
    votes["vi"] += accented
    plain = votes.pop("vi_plain", 0)
    letters = [] if accented else [w for w in tokens if w.isalpha()]
    if len(letters) >= 3 and all(map(str.isascii, letters)):
        syllables = sum(1 for w in letters if _SYLLABLE.match(w))
        if syllables >= 0.65 * len(letters) and plain > votes["en"]:  # Vietnamese typed without accents: all words are its syllables
            votes["vi"] += len(letters)
        elif plain >= 2 and plain > max(votes.values(), default=0):  # or mixed with foreign terms: no other language has as many of its words
            votes["vi"] += plain
    return +votes


def language(text: str, least: int = 2) -> str | None:
    """The language with most votes, if it has ``least`` and a clear lead; otherwise None."""
    ranked = language_votes(text).most_common(2)
    if not ranked or ranked[0][1] < least or (len(ranked) > 1 and ranked[0][1] < 1.3 * ranked[1][1]):
        return None
    return ranked[0][0]


_OPENING = frozenset(_BRACKETS.values())
_ANY_BRACKET = re.compile("[" + re.escape("".join({*_BRACKETS, *_OPENING})) + "]")


def _open_marks(text: str) -> bool:
    stack: list[str] = []
    for c in _ANY_BRACKET.findall(text):
        if c in _OPENING:
            stack.append(c)
        elif stack and stack[-1] == _BRACKETS[c]:
            stack.pop()
    return bool(stack) or text.count("**") % 2 == 1 or text.count("```") % 2 == 1


def _could_be_vietnamese(text: str) -> bool:
    letters = [w for w in _WORDS.findall(unicodedata.normalize("NFKC", text).casefold()) if w.isalpha()]
    return len(letters) < 4 or any(_VIETNAMESE.search(w) for w in letters) or sum(1 for w in letters if _SYLLABLE.match(fold(w))) >= 0.6 * len(letters)


def truncated(response: str, short: int = 12) -> bool:
    """Whether the response stops within a word, sentence, list or open mark.

    Without a closing sign, a lone phrase of at most ``short`` words and the last item of a list are whole
    unless they end in a word that never ends a sentence.
    """
    text = response.strip()
    if _open_marks(text):
        return True
    core = text.rstrip("*_` \t\n")
    if re.search(r"\n\s*(?:[-*•+–]|\(?\d{1,3}[.)])\s*$", core):
        return True
    while core and (unicodedata.category(core[-1]) in ("So", "Cf", "Mn", "Sk") or core[-1] in "\"”»’') "):
        core = core[:-1]
    if not core or core[-1] in ".!?…。！？" and not core.endswith((",.", "..,")):
        return False
    if core[-1] in ",:;-–—/(+&=":
        return True
    lines = core.split("\n")
    said = _WORDS.findall(unicodedata.normalize("NFKC", lines[-1]))
    if not said or re.search(r"\S+@\S+\.\w+$|https?://\S+$", lines[-1]):
        return False
    if m := _ITEM.match(lines[-1]):
        item = _WORDS.findall(unicodedata.normalize("NFKC", m.group(1)))
        return not item or _dangles(item)
    inner = _SENTENCES.split(lines[-1])
    if len(inner) > 1 or len([x for x in lines if x.strip()]) > 1:
        return True
    return len(said) > short or _dangles(said)


def _dangles(said: list[str]) -> bool:
    """Whether the last word is part of one (no vowel), or a word that never ends a sentence."""
    last = said[-1]
    if len(last) == 1 and last.isupper():  # a room or hall, unless nothing says so
        return len(said) > 1 and fold(said[-2]) not in _PLACES
    return last in _DANGLING or (last.isalpha() and (last[1:] or last).islower() and len(last) <= 3 and not re.search("[aeiouyà-ỹ]", last.lower().replace("đ", "d")))


def defect(prompt: str | None, response: str | None) -> str | None:
    said = words(response or "")
    if not said or " ".join(said) in PLACEHOLDERS:
        return "empty"
    if refuses(response, prompt or ""):
        return "refusal"
    if copies(prompt or "", response):
        return "copies_question"
    asked, told = language(prompt or "", 1), language(response)
    if asked and (told not in (None, asked) or (asked == "vi" and told is None and not _could_be_vietnamese(response))):
        return "other_language"
    return "truncated" if truncated(response) else None


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [defect(p, r) for p, r in zip(b["prompt"], b["response"])]
        yield pd.DataFrame({"id": b["id"], "defect": found}).dropna(subset=["defect"])


def defects(pairs: DataFrame, rid: Column, prompt: Column, response: Column) -> DataFrame:
    """``id, defect``: one row per defective pair."""
    rows = pairs.select(rid.cast("bigint").alias("id"), prompt.alias("prompt"), response.alias("response")).filter("id is not null").dropDuplicates(["id"])
    return rows.mapInPandas(_judge, "id bigint, defect string")
