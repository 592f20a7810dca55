"""Problem 4: text decoded with the wrong charset, found and restored by noisy-channel decoding.

The channel: somebody wrote words at their corpus frequency, bytes were made with one
charset and read with another, and some bytes were lost. A line becomes a
lattice: each chunk has one reading for each (read as, written as) pair
that its bytes allow, a chunk with lost bytes (U+FFFD) has the corpus words
that fit when these match anything. Emissions are the corpus frequencies of the words
read, changing the pair within a line costs a penalty, and Viterbi search
picks the readings.
"""

from __future__ import annotations

import codecs
import copy
import math
import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_rows, spread

#: Size of the word table sent to the workers (most frequent first; rarer words are joined), and the count a word needs to be one.
TABLE_WORDS = 200_000
LEAST_COUNT = 3
#: A reading replaces the text as it stands if its words are so many times as frequent.
RATIO = 6.0
#: A letter that is a word of its own in this share of the texts is read as another single byte only along with another word.
COMMON_SHARE = 0.006
SWITCH = 1.0
#: Distinct chunks a worker remembers.
MEMO = 300_000

# Charsets whose single bytes are read for each other, and those of several bytes.
_SINGLE = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "cp437", "cp850", "mac_cyrillic", "cp1253", "iso8859-15", "cp852")
_MULTI = ("utf-8", "shift_jis", "euc-jp")
PAIRS = (
    [(w, r) for w in _SINGLE for r in _MULTI]
    + [(w, r) for w in _SINGLE for r in _SINGLE if w != r]
    + [(w, r) for w in ("shift_jis", "cp932", "euc-jp", "gbk", "big5", "cp949", "utf-16-le", "utf-16-be") for r in ("utf-8", "shift_jis", "euc-jp") if w != r]
)

_CHUNK = re.compile(r"[^ \t\r\n]+")
_ODD_CHUNK = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~ "
_EAST = re.compile(r"[぀-ヿ㐀-鿿]")
_EAST_RUN = re.compile(r"[　-ヿ㐀-鿿＀-￯]+|[^\x00-\x7f　-ヿ㐀-鿿＀-￯]+")
_DIGITS = re.compile(r"\d+")
LOST = "�"
#: Words after which a character is one spoken about.
_SPOKEN = re.compile(r"(?i)(?:\b(?:signs?|symbols?|characters?|glyphs?|zeichen|signo|símbolo|signe|znak|символ|знак)|記号|文字)\W*$")
_CONTROL = re.compile("[\x80-\x9f]")

_HEADER_CHARSET = re.compile(rb"(?i)^content-type:[^\r\n]*charset\s*=\s*[\"']?([\w.:-]+)", re.M)
_META_CHARSET = re.compile(rb"(?i)<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)")
# Names that stand for a wider charset on the web, and charsets tried on bytes that are no UTF-8.
_WIDER = {"iso8859-1": "cp1252", "ascii": "cp1252", "shift_jis": "cp932"}
_TRIED = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp932", "euc_jp", "mac_roman", "cp850")
#: How much likelier a declared charset is than another (log).
DECLARED = 1.0


def units(chunk: str) -> list[str]:
    """What is counted of a chunk with a non-ASCII character: the word, or character pairs of an unspaced script."""
    if _EAST.search(chunk):
        out = []
        for run in _EAST_RUN.findall(chunk):
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
        return out
    w = _DIGITS.sub("0", chunk).strip(_EDGES).lower()
    return [w] if w and not w.isascii() else []


def word_counts(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``word, n``: in how many texts each unit stands, over all texts; summed per partition before the shuffle."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: Counter[str] = Counter()
        for (t,) in rows:
            if t and not t.isascii():
                own: set[str] = set()
                for c in set(_ODD_CHUNK.findall(t)):
                    own.update(units(c))
                seen.update(own)
                if len(seen) > 500_000:
                    yield from seen.items()
                    seen.clear()
        yield from seen.items()

    return map_rows(spread(df.select(text)), [text], "word string, n long", run).groupBy("word").agg(F.sum("n").alias("n"))


def masks(word: str) -> set[str]:
    """A word with its bytes beyond ASCII lost, one U+FFFD each or one a run; none for what cannot be told by that."""
    if _EAST.search(word) or LOST in word or _CONTROL.search(word):
        return set()
    return {re.sub(r"[^\x00-\x7f]", LOST, word), re.sub(r"[^\x00-\x7f]+", LOST, word)}


class Channel:
    """Readings of chunks under one corpus word table."""

    def __init__(self, counts: dict[str, int], texts: int, total: int | None = None):
        self.counts = counts
        self.total = math.log(max(1, sum(counts.values()) if total is None else total))
        self.common = math.log(max(20.0, COMMON_SHARE * texts)) - self.total
        self.margin = math.log(RATIO)
        self.known: dict[str, tuple[float, list[tuple[int, str, float]]]] = {}
        self.fits: dict[str, tuple[str, int]] = {}
        for w, n in counts.items():
            for masked in masks(w):
                if n > self.fits.get(masked, ("", 0))[1]:
                    self.fits[masked] = (w, n)
        self.forms: dict[str, list[tuple[int, str]]] = {}

    def beside(self, extra: list[tuple[str, str, int]]) -> Channel:
        """This channel with the words, too rare for the table, that one text needs: ``(word or masked word, word, count)``."""
        own = copy.copy(self)
        own.counts, own.fits, own.known = ChainMap({}, self.counts), ChainMap({}, self.fits), {}
        for key, word, n in extra:
            if key == word:
                own.counts[word] = n
            elif n > own.fits.get(key, ("", 0))[1]:
                own.fits[key] = (word, n)
        return own

    def score(self, chunk: str) -> float:
        """Mean log frequency of a chunk's units; 0 for plain ASCII."""
        if chunk.isascii():
            return 0.0
        own = units(chunk)
        if not own:
            return -self.total
        get = self.counts.get
        return sum(math.log(get(u, 0.3)) for u in own) / len(own) - self.total

    def mean(self, text: str) -> float:
        """Mean score of the distinct chunks that are not plain ASCII."""
        own = set(_ODD_CHUNK.findall(text))
        return sum(map(self.score, own)) / max(1, len(own))

    def variants(self, chunk: str) -> list[tuple[int, str]]:
        """``(pair, text)`` of all that a chunk may have been before it was misread, whatever its words."""
        found = self.forms.get(chunk)
        if found is not None:
            return found
        out: list[tuple[int, str]] = []
        seen = {chunk}
        raw: dict[str, bytes | None] = {}
        for k, (wrong, right) in enumerate(PAIRS):
            if wrong not in raw:
                try:
                    raw[wrong] = chunk.encode(wrong)
                except UnicodeError:
                    raw[wrong] = None
            if raw[wrong] is None:
                continue
            try:
                made = raw[wrong].decode(right)
            except UnicodeError:
                continue
            for again in (made, self._twice(made, wrong, right)):
                if again is None or again in seen or LOST in again or _CONTROL.search(again):
                    continue
                seen.add(again)
                if not again.isascii() or right == "utf-8":
                    out.append((k, again))
        return out

    def lost(self, chunk: str) -> list[str]:
        """Masked forms under which a chunk with lost bytes is looked up."""
        core = chunk.strip(_EDGES).lower()
        return [core, re.sub(r"[^\x00-\x7f]+", LOST, core)] if LOST in chunk else []

    def wanted(self, text: str) -> set[str]:
        """All words and masked words that the readings of a text may need and the table does not hold."""
        out: set[str] = set()
        for chunk in set(_ODD_CHUNK.findall(text)):
            if chunk not in self.known:
                for _, x in [(0, chunk), *self.variants(chunk)]:
                    out.update(u for u in units(x) if u not in self.counts)
                out.update(self.lost(chunk))
        return out

    def readings(self, chunk: str) -> tuple[float, list[tuple[int, str, float]]]:
        """Score of a chunk as it stands, and the better readings ``(pair, text, score)``; pair -1: lost bytes filled in."""
        known = self.known.get(chunk)
        if known is not None:
            return known
        as_is = self.score(chunk)
        out: list[tuple[int, str, float]] = []
        core = chunk.strip(_EDGES)
        for form in self.lost(chunk):
            fit = self.fits.get(form)
            if fit and fit[1] >= LEAST_COUNT:
                word = fit[0] if core[:1].islower() or not core[:1].isascii() else fit[0][:1].upper() + fit[0][1:]
                out.append((-1, chunk.replace(core, word), math.log(fit[1]) - self.total))
                break
        for k, again in self.variants(chunk):
            s = self.score(again) if not again.isascii() else -self.total
            if s > as_is + self.margin:
                out.append((k, again, s))
        out.sort(key=lambda x: -x[2])
        if len(self.known) > MEMO:
            self.known.clear()
        self.known[chunk] = (as_is, out)
        return as_is, out

    @staticmethod
    def _twice(made: str, wrong: str, right: str) -> str | None:
        if right != "utf-8" or made.isascii():
            return None
        try:
            return made.encode(wrong).decode(right)
        except UnicodeError:
            return None

    def weak(self, chunk: str, pair: int) -> bool:
        """Whether a reading tells nothing by itself: a common one-letter word, each letter being some other single byte."""
        core = chunk.strip(_EDGES)
        return pair >= 0 and PAIRS[pair][1] not in _MULTI and len(core) == 1 and core.isalpha() and self.score(chunk) >= self.common

    def line(self, text: str) -> tuple[str, list[tuple[int, int, str, int]]]:
        """The line restored, and its changed spans ``(start, end, as it stood, pair)``."""
        spots = [(m.start(), m.end(), m[0], *self.readings(m[0])) for m in _ODD_CHUNK.finditer(text)]
        if not any(s[4] or LOST in s[2] or _CONTROL.search(s[2]) for s in spots):
            return text, []
        # Viterbi over the line's chunks: one state for each pair, 0 for as it stands.
        best: dict[int | None, tuple[float, tuple]] = {None: (0.0, ())}
        for start, end, chunk, as_is, others in spots:
            floor = as_is - 2.0
            options: dict[int | None, tuple[float, str]] = {None: (as_is, chunk)}
            for k, made, s in others:
                if k not in options or s > options[k][0]:
                    options[k] = (s, made)
            step: dict[int | None, tuple[float, tuple]] = {}
            top_state, (top, top_path) = max(best.items(), key=lambda x: x[1][0])
            for state in {*options, *best}:
                s, made = options.get(state, (floor, chunk))
                stay = best.get(state)
                if stay is not None and stay[0] >= top - SWITCH:
                    step[state] = (stay[0] + s, (stay[1], (start, end, chunk, made, state)))
                else:
                    step[state] = (top - SWITCH + s, (top_path, (start, end, chunk, made, state)))
            best = step
        _, path = max(best.values(), key=lambda x: x[0])
        taken = []
        while path:
            path, spot = path
            taken.append(spot)
        out, at, changed = [], 0, []
        for start, end, chunk, made, state in reversed(taken):
            if _SPOKEN.search(text[max(0, start - 24) : start]):
                continue
            if state is None and LOST not in chunk and not _CONTROL.search(chunk):
                continue
            if made == chunk and LOST not in chunk and not _CONTROL.search(chunk):
                continue
            out += [text[at:start], made]
            at = end
            changed.append((start, end, made, -2 if state is None else state))
        return "".join(out) + text[at:], changed

    def text(self, text: str) -> tuple[str, int]:
        """The text restored, and how many of its chunks were affected.

        A garbled chunk whose right form stands in the same line is a quotation
        in a text about such garbling, and stays. A weak reading needs another
        chunk of the text that was misread the same way.
        """
        if text.isascii():
            return text, 0
        lines = [(line, *((line, []) if line.isascii() else self.line(line))) for line in text.split("\n")]
        misread: dict[int, set[str]] = {}
        for line, _, changed in lines:
            for start, end, _, pair in changed:
                misread.setdefault(pair, set()).add(line[start:end].strip(_EDGES).lower())
        alone = {k for k, chunks in misread.items() if len(chunks) == 1 and self.weak(next(iter(chunks)), k)}
        out, hits = [], 0
        for line, made, changed in lines:
            if alone and any(c[3] in alone for c in changed):
                changed = [c for c in changed if c[3] not in alone]
                made, at = "", 0
                for start, end, word, _ in changed:
                    made += line[at:start] + word
                    at = end
                made += line[at:]
            if changed:
                words = {c.strip(_EDGES).lower() for c in _CHUNK.findall(line)}
                told = [c for c in changed if c[2] != line[c[0] : c[1]] and c[2].strip(_EDGES).lower() in words]
                if len(told) == len(changed):
                    made = line
                else:
                    hits += len(changed) - len(told)
            out.append(made)
        return "\n".join(out), hits


def _whole(raw: bytes, name: str) -> str | None:
    """Bytes in a charset, None if they are not in it; a character cut off at the end becomes U+FFFD."""
    try:
        decoder = codecs.getincrementaldecoder(name)()
        return decoder.decode(raw) + (LOST if decoder.getstate()[0] else "")
    except (LookupError, UnicodeError):
        return None


def forms(content: bytes, every: bool = True) -> tuple[list[tuple[str, float]], str | None]:
    """What the page of a payload (without its HTTP header) may read as, each with the log odds of its charset, and the page with
    ill-formed bytes as U+FFFD; for UTF-8 that reading alone and None. Without ``every`` only the declared charsets."""
    head, page = b"", content
    if content.startswith(b"HTTP/"):
        for blank in (b"\r\n\r\n", b"\n\n"):
            if blank in content:
                head, page = content.split(blank, 1)
                break
    text = _whole(page, "utf-8")
    if text is not None and not (text.endswith(LOST) and text[:-1].isascii()):
        return [(text, 0.0)], None
    declared = []
    for m in (_HEADER_CHARSET.search(head), _META_CHARSET.search(page)):
        if m:
            try:
                name = codecs.lookup(m[1].decode("latin-1")).name
            except LookupError:
                continue
            declared.append(_WIDER.get(name, name))
    names = dict.fromkeys([*declared, *(_TRIED if every else ())])
    return [(made, DECLARED if x in declared else 0.0) for x in names if (made := _whole(page, x)) is not None], page.decode("utf-8", "replace")


def decode(content: bytes, channel: Channel | None = None) -> str:
    """The page of a payload (without its HTTP header) in the charset it was written in.

    UTF-8 if it is that; else the charset of the header, of the page or one of
    a fixed list, whichever reads the likeliest words. Without a ``channel`` the first declared one that fits.
    Only if none fits do ill-formed bytes become U+FFFD.
    """
    found, replaced = forms(content, channel is not None)
    if replaced is None or channel is None:
        return found[0][0] if found else replaced
    best, most = replaced, -math.inf
    for made, odds in found:
        s = channel.mean(made) + odds
        if s > most:
            best, most = made, s
    return replaced if channel.mean(replaced) > most else best


@dataclass
class Model:
    """The table sent to the workers (words and their counts, how many texts, the sum of all words' counts), and ``word, n`` of those it does not hold, if there are any."""

    table: Broadcast
    rest: DataFrame | None = None


def fit(df: DataFrame, key: str = "id", text: str = "text", size: int = TABLE_WORDS) -> Model:
    """The channel's word counts, over all texts.

    The ``size`` most frequent words are sent to the workers; if there are more, the others are joined to the texts that need them.
    """
    words = durable(word_counts(df, key, text).where(F.col("n") >= LEAST_COUNT))
    many = words.count() > size
    top = words.orderBy(F.desc("n"), "word").limit(size) if many else words
    found = top.toArrow()
    counts = dict(zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True))
    texts = df.select(F.count(F.lit(1))).first()[0]
    total = words.agg(F.sum("n")).first()[0] if many else sum(counts.values())
    return Model(df.sparkSession.sparkContext.broadcast((counts, texts, total)), words.join(top.select("word"), "word", "left_anti") if many else None)


_channels: dict[int, tuple[tuple, Channel]] = {}


def _channel(table: Broadcast) -> Channel:
    """One channel a worker process and model; kept with the broadcast's value, so that its identity stays its own."""
    value = table.value
    if id(value) not in _channels:
        _channels.clear()
        _channels[id(value)] = value, Channel(*value)
    return _channels[id(value)][1]


_EXTRA = "array<struct<key string, word string, n long>>"


def _extra(source: DataFrame, column: str, model: Model, wanted: Callable[[Channel, object], set[str]]) -> DataFrame:
    """``uid, extra``: of the rows ``uid, column`` those words of ``wanted(channel, value)`` that the model's table does not hold."""
    table = model.table

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = _channel(table)
        for uid, x in rows:
            yield from ((uid, w) for w in wanted(own, x))

    def masked(rows: Iterator[tuple]) -> Iterator[tuple]:
        for word, n in rows:
            yield from ((k, word, n) for k in {word, *masks(word)})

    rest = map_rows(model.rest, ["word", "n"], "key string, word string, n long", masked)
    rest = rest.groupBy("key").agg(F.max_by(F.struct("word", "n"), "n").alias("w")).select("key", "w.word", "w.n")
    asked = map_rows(spread(source), ["uid", column], "uid long, key string", run).distinct()
    return asked.join(rest, "key").groupBy("uid").agg(F.collect_list(F.struct("key", "word", "n")).alias("extra"))


def _wanted_of_text(channel: Channel, text: str | None) -> set[str]:
    return channel.wanted(text) if text and not text.isascii() else set()


def _wanted_of_content(channel: Channel, content: bytes | None) -> set[str]:
    """Words by which the charset of a payload is chosen, and those its text may need then, whichever is chosen."""
    from .pages import strip_markup

    out: set[str] = set()
    if content:
        found, replaced = forms(content)
        for page in [x for x, _ in found] + ([] if replaced is None else [replaced]):
            out |= _wanted_of_text(channel, strip_markup(page))
            if replaced is not None:
                out.update(u for chunk in set(_ODD_CHUNK.findall(page)) for u in units(chunk) if u not in channel.counts)
    return out


def with_words(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """The rows of ``key, text`` with the column ``extra`` of what ``Channel.beside`` takes (null where the table holds all words)."""
    if model.rest is None:
        return df.select(key, text, F.lit(None).cast(_EXTRA).alias("extra"))
    source = df.select(key, text, F.xxhash64(key, text).alias("uid"))
    return source.join(_extra(source, text, model, _wanted_of_text), "uid", "left").select(key, text, "extra")


def contents(records: DataFrame, model: Model | None) -> DataFrame:
    """``path, ordinal, id, content`` of the response records with the column ``extra`` as of ``with_words``."""
    pages = records.where(F.col("type") == "response").select("path", "ordinal", "id", "content")
    if model is None or model.rest is None:
        return pages.withColumn("extra", F.lit(None).cast(_EXTRA))
    source = pages.withColumn("uid", F.xxhash64("path", "ordinal"))
    return source.join(_extra(source, "content", model, _wanted_of_content), "uid", "left").drop("uid")


def _for(own: Channel, extra: list | None) -> Channel:
    return own.beside([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in extra]) if extra else own


def restore(df: DataFrame, key: str = "id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``key, text, affected INT``: every row's text restored where that can be done, and how many chunks were affected.

    Null stays null with 0; an empty table and texts of plain ASCII pass unchanged. Row-local after the count of words.
    """
    model = model or fit(df, key, text)
    table = model.table

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = _channel(table)
        for k, t, extra in rows:
            if t is None:
                yield k, None, 0
            else:
                yield k, *_for(own, extra).text(t)

    return map_rows(spread(with_words(df, model, key, text)), [key, text, "extra"], f"`{key}` string, `{text}` string, affected int", run)


def record_texts(records: DataFrame, model: Model) -> DataFrame:
    """``path, ordinal, id, text, affected INT`` of the response records: bytes decoded, markup stripped, garbled text restored."""
    from .pages import strip_markup

    table = model.table

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        shared = _channel(table)
        for path, ordinal, i, content, extra in rows:
            own = _for(shared, extra)
            yield path, ordinal, i, *((None, 0) if content is None else own.text(strip_markup(decode(content, own))))

    return map_rows(spread(contents(records, model)), ["path", "ordinal", "id", "content", "extra"], "path string, ordinal long, id string, text string, affected int", run)


def affected_ids(df: DataFrame, key: str = "id", text: str = "text", model: Model | None = None) -> DataFrame:
    """``key``: distinct ids of texts with at least one character decoded with the wrong charset."""
    model = model or fit(df, key, text)
    table = model.table

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = _channel(table)
        for k, t, extra in rows:
            if k is not None and t and _for(own, extra).text(t)[1]:
                yield (k,)

    return map_rows(spread(with_words(df, model, key, text)), [key, text, "extra"], f"`{key}` string", run).distinct()
