"""Problem 5: per-document quality statistics and the nearest structural profile.

Each line of a main body is described by how its words fall on classes (articles,
other function words, plain words, capitalised words, numbers, symbols, oversized
strings) and is assigned to the structural profile whose distribution is nearest by
Jensen-Shannon divergence. The prose profile of each language is measured over the corpus: the
distribution over all lines of main bodies that end as sentences do. A body whose characters
lie mostly in lines of other profiles is a list, a table or junk.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages, residue
from .common import durable, map_rows, spread
from .languages import FUNCTION_WORDS
from .pages import is_credit

#: Share of a body's characters in prose lines from which the body is prose.
PROSE_SHARE = 0.5

# Articles, which lists of things use as much as prose does.
ARTICLES = {
    "en": "a an the",
    "es": "el la los las un una unos unas",
    "de": "der die das den dem des ein eine einen einem einer",
    "fr": "le la les l un une des",
    "pt": "o a os as um uma",
    "pl": "",
    "ru": "",
    "ja": "",
}
_ART = {k: frozenset(v.split()) for k, v in ARTICLES.items()}
_FUN = {k: frozenset(v) - _ART[k] | (frozenset("d qu n s c j m t".split()) if k == "fr" else frozenset()) for k, v in FUNCTION_WORDS.items()}
_ALL = {k: _ART[k] | _FUN[k] for k in _ART}

CLASSES = ("article", "function", "word", "capital", "number", "symbol", "string")
#: Shapes that are not prose, as stated prototypes (shares of the classes).
SHAPES = {
    "list-plain": (0.00, 0.01, 0.45, 0.35, 0.09, 0.09, 0.01),
    "list-named": (0.00, 0.01, 0.10, 0.65, 0.10, 0.13, 0.01),
    "list-numbered": (0.00, 0.01, 0.24, 0.40, 0.20, 0.14, 0.01),
    "list-articles": (0.27, 0.03, 0.30, 0.30, 0.05, 0.04, 0.01),
    "table-named": (0.00, 0.01, 0.10, 0.40, 0.32, 0.16, 0.01),
    "table-numbers": (0.00, 0.00, 0.08, 0.12, 0.55, 0.24, 0.01),
    "junk-string": (0.00, 0.00, 0.08, 0.06, 0.10, 0.26, 0.50),
    "junk-log": (0.00, 0.00, 0.22, 0.08, 0.45, 0.22, 0.03),
    "junk-words": (0.02, 0.03, 0.90, 0.02, 0.01, 0.01, 0.01),
    "junk-repeat": (0.05, 0.01, 0.60, 0.31, 0.01, 0.01, 0.01),
}
#: What prose of a language is taken to be before any is measured, and how many words that weighs as much as.
EXPECTED = {
    "prose-en": (0.15, 0.30, 0.40, 0.10, 0.02, 0.02, 0.01),
    "prose-es": (0.12, 0.36, 0.33, 0.14, 0.02, 0.02, 0.01),
    "prose-de": (0.13, 0.32, 0.20, 0.30, 0.02, 0.02, 0.01),
    "prose-fr": (0.14, 0.35, 0.33, 0.13, 0.02, 0.02, 0.01),
    "prose-pt": (0.16, 0.36, 0.30, 0.13, 0.02, 0.02, 0.01),
    "prose-pl": (0.00, 0.25, 0.55, 0.15, 0.02, 0.02, 0.01),
    "prose-ru": (0.00, 0.28, 0.50, 0.17, 0.02, 0.02, 0.01),
    "prose-ja": (0.00, 0.50, 0.35, 0.09, 0.02, 0.03, 0.01),
}
EXPECTED_WORDS = 500
#: Words that a line needs to tell of its language's prose.
PROSE_WORDS = 8
#: Distinct words a worker remembers.
MEMO = 100_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/-]\d+)*|[^\w\s]+|_+")
_ASCII_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+(?:[.,:/-][0-9]+)*|[^A-Za-z0-9_ \t\r\n\f\v]+|_+", re.A)
_KANA_TOKEN = re.compile(r"[぀-ゟ]|[゠-ヿ]+|[㐀-鿿]+|[A-Za-z]+|\d+(?:[.,:/-]\d+)*|[^\w\s]+")
_KANA = re.compile(r"[぀-ゟ]")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Charsets that text is read in for each other, for lines that carry no language as they stand.
_MISREAD = (("cp1252", "utf-8"), ("cp1252", "cp1251"), ("latin-1", "utf-8"), ("latin-1", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "utf-8"), ("cp1250", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "utf-8"), ("iso8859-2", "cp1250"), ("cp1252", "shift_jis"), ("latin-1", "shift_jis"), ("latin-1", "euc-jp"), ("cp1252", "koi8-r"), ("mac_roman", "cp1251"), ("shift_jis", "utf-8"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "cp866"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "euc-jp"), ("cp866", "utf-8"))
_ENDINGS = frozenset(".!?…。！？:;\"'”»)")
_END = re.compile(r"[.!?…。！？:;\"'”»)]\s*$")
#: Characters that hardly any script uses among its letters, but wrong decoding yields.
_GARBLE = re.compile(r"[\x80-\xbf\u0192\u02c6\u02dc\u2018-\u203a\u20ac\u2122\u2200-\u25ff\ufffd\uff61-\uff9f]|[\u0400-\u040f\u0450\u0452-\u045f]|[À-ÿ](?=[À-ÿ])")
_BLANKS = re.compile(r"\s+")


def _tokens(line: str) -> list[str]:
    return (_ASCII_TOKEN if line.isascii() else _TOKEN).findall(line)


def divergence(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence in bits."""
    out = 0.0
    for x, y in zip(p, q, strict=True):
        m = (x + y) / 2
        if x:
            out += x * math.log2(x / m) / 2
        if y:
            out += y * math.log2(y / m) / 2
    return out


_LANGS = tuple(_ALL)
#: Languages (by number) that each function word is of.
_OF: dict[str, tuple[int, ...]] = {}
for _i, _own in enumerate(_ALL.values()):
    for _w in _own:
        _OF[_w] = (*_OF.get(_w, ()), _i)


class _Words(dict):
    """Languages of a word as it is written, remembered; () for most words, None for what is no word."""

    def __missing__(self, w: str) -> tuple[int, ...] | None:
        got = _OF.get(w.lower(), ()) if w[0].isalpha() else None
        if len(self) < MEMO:
            self[w] = got
        return got


class _Sorts(dict):
    """Class of a token in one language: an index of ``CLASSES``, 7 for what does not count, 8 for what weighs by its length."""

    def __init__(self, lang: str):
        super().__init__()
        self.articles, self.functions = _ART.get(lang, frozenset()), _FUN.get(lang, frozenset())

    def __missing__(self, t: str) -> int:
        c = t[0]
        if c.isalpha():
            low = t.lower()
            got = 8 if len(t) > 24 else 1 if low in self.functions else 0 if low in self.articles else 3 if c.isupper() and not t.isupper() else 2
        elif c.isdigit():
            got = 4
        else:
            got = 7 if t in _PLAIN_MARKS else 5 if len(t) <= 2 else 8
        if len(self) < MEMO:
            self[t] = got
        return got


#: What a chunk is if no token of it counts, and if it is not one token of one class.
NOTHING, MIXED = 7, 8


class _Chunks(dict):
    """Of a chunk between blanks, the class of its token in one language, ``NOTHING`` or ``MIXED``.

    Tokens never reach over a blank, so a line's classes are those of its chunks, which are few and remembered.
    """

    def __init__(self, lang: str):
        super().__init__()
        self.sorts = _Sorts(lang)
        self.mixed: dict[str, tuple[tuple[int, float], ...]] = {}

    def classes(self, chunk: str) -> tuple[tuple[int, float], ...]:
        """The classes of all tokens of a chunk that count, and how much each counts."""
        if chunk in self.mixed:
            return self.mixed[chunk]
        sort = self.sorts
        found: dict[int, float] = {}
        for t in _tokens(chunk):
            c = sort[t]
            if c == 8:
                c, n = (6, len(t) / 6) if t[0].isalpha() else (5, len(t))
                found[c] = found.get(c, 0) + n
            elif c != 7:
                found[c] = found.get(c, 0) + 1
        # A chunk that mixes everything is one string, however it falls apart.
        if len(chunk) > 30:
            found[6] = found.get(6, 0) + len(chunk) / 6
        return tuple(found.items())

    def __missing__(self, chunk: str) -> int:
        own = self.classes(chunk)
        got = NOTHING if not own else own[0][0] if len(own) == 1 and own[0][1] == 1 else MIXED
        if len(self) < MEMO:
            self[chunk] = got
            if got == MIXED:
                self.mixed[chunk] = own
        return got


class _Speech:
    """How many words a chunk has, and the function words among them with their languages; chunks that are alike in this share one."""

    __slots__ = ("functions", "words")

    def __init__(self, words: int, functions: tuple[tuple[str, tuple[int, ...]], ...]):
        self.words, self.functions = words, functions


class _Spoken(dict):
    """The ``_Speech`` of a chunk, remembered; there are few different ones, so a text's are counted instead of its chunks."""

    def __init__(self) -> None:
        super().__init__()
        self.shared: dict[tuple, _Speech] = {}

    def __missing__(self, chunk: str) -> _Speech:
        own = [(t, langs) for t in _tokens(chunk) if (langs := _words[t]) is not None]
        what = len(own), tuple(x for x in own if x[1])
        got = self.shared.get(what)
        if got is None:
            got = _Speech(*what)
            if len(self.shared) < MEMO:
                self.shared[what] = got
        if len(self) < MEMO:
            self[chunk] = got
        return got


_PLAIN_MARKS = frozenset([".", ",", "(", ")", "?", "!", "'", "’", "-", "—", "–", '"', "¿", "¡", "«", "»"])
_words = _Words()
_spoken = _Spoken()
_chunks: dict[str, _Chunks] = {lang: _Chunks(lang) for lang in ("", *_ALL)}


def tongue_of(seen: Counter[str]) -> tuple[str, float]:
    """The language most of whose function words are among counted tokens, and their share of the words; ``("", 0)`` if hardly any is."""
    hits, kinds, total = [0] * len(_LANGS), [0] * len(_LANGS), 0
    of = _words
    for t, n in seen.items():
        langs = of[t]
        if langs is not None:
            total += n
            for i in langs:
                hits[i] += n
                kinds[i] += 1
    # Of equally many words, more different ones speak for a language.
    best = max(range(len(_LANGS)), key=lambda i: (hits[i] * (1 + 0.02 * kinds[i]), -i))
    share = hits[best] / max(1, total)
    return (_LANGS[best], share) if share > 0.04 else ("", 0.0)


def tongue_of_chunks(chunks: Iterable[str]) -> tuple[str, float]:
    """``tongue_of`` the tokens of chunks."""
    hits, total = [0] * len(_LANGS), 0
    kinds: list[set[str]] = [set() for _ in _LANGS]
    for speech, n in Counter(map(_spoken.__getitem__, chunks)).items():
        total += speech.words * n
        for t, langs in speech.functions:
            for i in langs:
                hits[i] += n
                kinds[i].add(t)
    best = max(range(len(_LANGS)), key=lambda i: (hits[i] * (1 + 0.02 * len(kinds[i])), -i))
    share = hits[best] / max(1, total)
    return (_LANGS[best], share) if share > 0.04 else ("", 0.0)


def tongue(text: str) -> tuple[str, float]:
    """``tongue_of`` a text; Japanese by its kana."""
    if not text.isascii() and (kana := len(_KANA.findall(text))) > 0.12 * len(text):
        return "ja", kana / len(text)
    return tongue_of(Counter(_LETTERS.findall(text)))


def counts(line: str, lang: str, chunks: list[str] | None = None) -> list[float]:
    """How often a line's words fall on each of ``CLASSES``."""
    n: list[float] = [0] * 7
    if lang == "ja":
        for t in _KANA_TOKEN.findall(line):
            c = t[0]
            if "぀" <= c <= "ゟ":
                n[1] += 0.5
            elif c >= "゠" and c.isalpha():
                n[2] += 1
            elif c.isdigit():
                n[4] += 1
            elif c.isalpha():
                n[3 if c.isupper() else 2] += 1
            elif t not in "、。":
                n[5] += 1
        return n
    if chunks is None:
        chunks = line.split()
    own = _chunks[lang]
    found = bytes(map(own.__getitem__, chunks))
    n = [found.count(c) for c in range(7)]
    if MIXED in found:
        for classes, k in Counter(own.classes(x) for x, c in zip(chunks, found, strict=True) if c == MIXED).items():
            for i, x in classes:
                n[i] += x * k
    return n


def readable(own: list[str], strength: float) -> list[str]:
    """Lines whose letters carry a language poorly, read with the charset under which they carry one better, if there is one."""
    for _ in range(2):  # text can be misread twice
        whole = "\n".join(own)
        best = None
        raw: dict[str, bytes] = {}
        tried: set[str] = set()
        for wrong, right in _MISREAD:
            if wrong not in raw:
                raw[wrong] = whole.encode(wrong, "ignore")
            made = raw[wrong].decode(right, "ignore")
            if len(made) <= 0.3 * len(whole) or made in tried:  # the same text is no better the second time
                continue
            tried.add(made)
            found = tongue(made)[1]
            if found > max(0.12, 1.15 * strength):
                best, strength = (wrong, right), found
        if best is None:
            break
        own = [x.encode(best[0], "ignore").decode(best[1], "ignore") for x in own]
    return own


def core(lines: list[str], keep: list[int]) -> tuple[list[str], list[list[str]]]:
    """Lines of a main body without headline, byline, dates (both as ``pages.Weights.keep`` has them) and credits, and the chunks of each."""
    own = [lines[i] for i in keep[1:] if i >= 0]
    chunks = [x.split() for x in own if not is_credit(x)]
    own = list(map(" ".join, chunks))
    for i, x in enumerate(own):
        if "&" in x:
            own[i] = html.unescape(x)
            chunks[i] = own[i].split()
    return own, chunks


def garbled(line: str) -> bool:
    """Whether an eighth of a line's characters, about, are such as wrong decoding yields; none of these is ASCII."""
    least = 0.12 * len(line)
    return len(line) - len(line.encode("ascii", "ignore")) > least and len(_GARBLE.findall(line)) > least


Structure = tuple[str, list[tuple[list[float], int, int]]]


def structure(own: list[str], chunks: list[list[str]] | None = None) -> Structure:
    """The language of a body, and of each line (with its ``chunks``, as of ``core``) the counts on ``CLASSES``, its length, and what decides beside them.

    The last is 1 for a line that ends as a sentence, 2 for one too short for prose, 4 for a paragraph that was decoded wrongly.
    """
    text = "\n".join(own)
    if not text or text.isspace():
        return "", []
    plain = text.isascii()
    if not plain and (kana := len(_KANA.findall(text))) > 0.12 * len(text):
        lang, strength, chunks = "ja", kana / len(text), [None] * len(own)
    else:
        chunks = [x.split() for x in own] if chunks is None else chunks
        lang, strength = tongue_of_chunks(chain.from_iterable(chunks))
    whole = False
    if strength < 0.2 and not plain:
        odd = len(text) - len(text.encode("ascii", "ignore"))
        if odd > 0.02 * len(text):
            fixed = readable(own, strength)
            if fixed is not own:
                own = fixed
                lang = tongue("\n".join(own))[0]
                chunks = [None] * len(own)
            else:
                # Unreadable, but in paragraphs.
                whole = strength < 0.1 and odd > 0.15 * len(text) and sum(map(len, own)) > 60 * len(own) and sum(c.isdigit() for c in text) < 0.1 * len(text)
    out = []
    for line, have in zip(own, chunks, strict=True):
        n = counts(line, lang, have)
        flags = 1 if line[-1:] in _ENDINGS else 0  # lines of ``core`` end in no blank
        if len(line) < 12 if lang == "ja" else sum(n[:4]) < 4:
            flags |= 2
        if whole or len(line) > 60 and not line.isascii() and garbled(line):
            flags |= 4
        out.append((n, len(line), flags))
    return lang, out


class Profiles:
    """Structural profiles, prose ones as measured."""

    def __init__(self, measured: dict[str, list[float]] | None = None):
        self.all = dict(SHAPES)
        for name, expected in EXPECTED.items():
            n = [EXPECTED_WORDS * x for x in expected]
            for i, x in enumerate((measured or {}).get(name.partition("-")[2], ())):
                n[i] += x
            self.all[name] = tuple(x / sum(n) for x in n)
        self.known: dict[tuple[int, ...], str] = {}

    def kind(self, twentieths: tuple[int, ...]) -> str:
        """The kind of the nearest profile to such shares of the classes, each a number of twentieths."""
        got = self.known.get(twentieths)
        if got is None:
            p = tuple(x / 20 for x in twentieths)
            got = min(self.all, key=lambda name: divergence(p, self.all[name])).partition("-")[0]
            if len(self.known) < MEMO:
                self.known[twentieths] = got
        return got

    def shape(self, found: Structure) -> tuple[str, float]:
        """``(kind, share of characters in prose lines)``: kind prose, list, table or junk; prose for a body of nothing."""
        kinds: Counter[str] = Counter()
        for n, size, flags in found[1]:
            total = sum(n)
            kind = self.kind(tuple([round(20 * x / total) for x in n])) if total else "table"
            if kind == "prose" and flags & 2:
                kind = "list"
            if kind != "prose" and flags & 4:
                kind = "prose"
            kinds[kind] += size
        total = sum(kinds.values())
        if not total:
            return "prose", 0.0
        share = kinds["prose"] / total
        if share >= PROSE_SHARE:
            return "prose", share
        del kinds["prose"]
        return kinds.most_common(1)[0][0], share


_profiles: dict[int, tuple[dict, Profiles]] = {}


def _profiles_of(value: dict[str, tuple[float, ...]]) -> Profiles:
    """One a worker process and broadcast value, so that what is known of the nearest profiles stays; kept with the value, so that its identity stays its own."""
    if id(value) not in _profiles:
        _profiles.clear()
        made = Profiles()
        made.all = value
        _profiles[id(value)] = value, made
    return _profiles[id(value)][1]


def packed(found: Structure) -> str:
    """A structure as one string, so that a row of ``residue.fragments`` can carry it."""
    return json.dumps(found, separators=(",", ":"))


def unpacked(text: str) -> Structure:
    lang, lines = json.loads(text)
    return lang, list(map(tuple, lines))


def structures(df: DataFrame, model: pages.Model, key: str = "id", text: str = "text") -> DataFrame:
    """Fragments of ``residue`` with the ``packed`` structure of each body in the rows ``ADDED``: one pass for both."""
    return residue.fragments(df, model, key, text, lambda k, lines, keep: packed(structure(*core(lines, keep))))


def measured(found: DataFrame, words: str = "words") -> Profiles:
    """Profiles with the prose of each language as all sentence-like lines of the corpus have it; what reaches the driver is a row a language."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[str, list[float]] = {}
        for (packed_lines,) in rows:
            lang, lines = unpacked(packed_lines)
            for n, _, flags in lines:
                if lang and flags == 1 and sum(n) >= PROSE_WORDS:
                    own = sums.setdefault(lang, [0.0] * len(CLASSES))
                    for i, x in enumerate(n):
                        own[i] += x
        yield from ((lang, i, x) for lang, own in sums.items() for i, x in enumerate(own))

    rows = map_rows(found.select(words), [words], "lang string, i int, n double", run).groupBy("lang", "i").agg(F.sum("n").alias("n")).collect()
    sums: dict[str, list[float]] = {}
    for lang, i, n in rows:
        sums.setdefault(lang, [0.0] * len(CLASSES))[i] = n
    return Profiles(sums)


def kinds_of(found: DataFrame, key: str = "id", words: str = "words") -> DataFrame:
    """``key, kind, prose_share, language`` of each row with a packed structure."""
    profiles = found.sparkSession.sparkContext.broadcast(measured(found, words).all)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = _profiles_of(profiles.value)
        for k, w in rows:
            made = unpacked(w)
            yield k, *own.shape(made), made[0]

    return map_rows(found.select(key, words), [key, words], f"`{key}` string, kind string, prose_share double, language string", run)


def not_prose_ids(df: DataFrame, key: str = "id", text: str = "text", model: pages.Model | None = None) -> DataFrame:
    """``key``: distinct ids of texts whose main body is a list, a table or junk, and no residue (``residue.ids_of``).

    Null and empty texts and null ids give none. Texts are read twice: for the line-block weights, and for bodies.
    """
    model = model or pages.fit(df, key, text)
    found = durable(structures(df, model, key, text))
    odd = kinds_of(found.where(F.col("sort") == residue.ADDED)).where("kind <> 'prose'").select("id").distinct()
    return odd.join(residue.ids_of(found), "id", "left_anti").withColumnRenamed("id", key)


def statistics(df: DataFrame, key: str = "id", text: str = "text", model: pages.Model | None = None) -> DataFrame:
    """One row of statistics for each input row (null text: null statistics; empty text: zeros).

    ``words, mean_word, symbol_ratio, digit_ratio, lines, ending_lines`` (share of
    non-blank lines that end in punctuation), ``common_words`` (share of function
    words of the nearest language), ``language, kind, prose_share`` of the main body. Row-local after the profiles are measured.
    """
    model = model or pages.fit(df, key, text)
    weights = model.weights

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        memo: dict[str, pages.Line] = {}
        for k, t, rare in rows:
            if t is None:
                yield (k,) + (None,) * 8 + (packed(("", [])),)
                continue
            seen = _LETTERS.findall(t)
            lines = [x for x in t.split("\n") if x.strip()]
            lang = tongue(t)[0]
            size = max(1, len(t))
            common = _ALL.get(lang, frozenset())
            yield (
                k,
                len(seen),
                sum(map(len, seen)) / len(seen) if seen else 0.0,
                sum(not c.isalnum() and not c.isspace() for c in t) / size,
                sum(c.isdigit() for c in t) / size,
                len(lines),
                sum(bool(_END.search(x)) for x in lines) / len(lines) if lines else 0.0,
                sum(w.lower() in common for w in seen) / len(seen) if seen else 0.0,
                lang,
                packed(structure(*core(*pages.body_lines(t, weights.value, rare, memo)))),
            )

    plain = "words int, mean_word double, symbol_ratio double, digit_ratio double, lines int, ending_lines double, common_words double, language string"
    each = durable(map_rows(spread(pages.with_rare(df, model, key, text)), [key, text, "rare"], f"`{key}` string, {plain}, _packed string", run))
    names = [x.split()[0] for x in plain.split(", ")]
    profiles = each.sparkSession.sparkContext.broadcast(measured(each, "_packed").all)

    def last(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = _profiles_of(profiles.value)
        for *row, made in rows:
            yield *row, *((None, None) if row[1] is None else own.shape(unpacked(made)))

    return map_rows(each, [key, *names, "_packed"], f"`{key}` string, {plain}, kind string, prose_share double", last)


def basic_counts(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, chars, words, digits, lines, ending`` of each row's whole text: characters, runs of letters, ASCII digits, lines
    with a non-white character, lines that end in a full stop, exclamation or question mark. Built-in expressions alone; null gives nulls."""
    c = F.col(text)
    return df.select(
        key,
        F.char_length(c).cast("long").alias("chars"),
        F.regexp_count(c, F.lit(r"\p{L}+")).cast("long").alias("words"),
        F.char_length(F.regexp_replace(c, "[^0-9]", "")).cast("long").alias("digits"),
        F.regexp_count(c, F.lit(r"[^ \t\r\n\f\x0B][^\n]*")).cast("long").alias("lines"),
        F.regexp_count(c, F.lit(r"[.!?][ \t\r\f\x0B]*(?:\n|\z)")).cast("long").alias("ending"),
    )
