"""Problem 1: template residue, filler and error pages, by aligning same-template records.

All sentences of all main bodies are aligned by their shape (how many words, and the
first two or the last two of them, of up to three words one; names and identifiers are holes). Two
things are counted of each shape over the corpus: how many records have it, and
what share of their page's content it makes up on average. A shape that makes up a good part
of most pages on which it stands is a *whole-page template*: what a site
delivers instead of content. The records of such shapes are aligned word by word; positions without a
majority word are slots, the others the template. A page with such a fragment is residue.

In all other sentences, whatever stands in the syntax of an unfilled variable (also
a blank one) is a slot's filler that was never replaced, and so is a sentence of the
usual filler text. The words around such a slot are aligned over the corpus as well: if the
same words stand around it in many records, always with a variable between them, then
the sentence is a fixed one that speaks about variables, and is real content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pages
from .common import durable, map_rows, spread

#: Records that must share a shape to be a template, and the share of their pages' content it must make up on average.
SUPPORT = 5
COVER = 0.25
#: Share of its own page's content from which a fragment can be a whole-page message.
OWN = 0.1
#: Share of one word that makes a position fixed, and the share of positions that must be fixed.
FIXED_SHARE = 0.5
FIXED_PLACES = 0.4
#: Records in which the same words must stand around a variable to be a sentence about variables, and how many words each side.
SPOKEN = 8
AROUND = 4

# Syntaxes of unfilled variables, by which a slot's filler is known.
PLACEHOLDER = re.compile(r"\{\{[^{}\n]*\}\}|\{%[^{}\n]*%\}|[$#]\{[^{}\n]*\}|%%[A-Za-z][\w. ]*%%|\[\[[A-Za-z][\w. ]*\]\]|__[A-Za-z](?:[A-Za-z0-9.]|_(?!_))*__|\{[A-Z][A-Z0-9_]+\}|\[(?:INSERT|[Ii]nsert) [^\[\]\n]+\]|<%=?[^%\n]*%>|\*\|[A-Z_]+\|\*")
_HOLDS = re.compile(r"[{%\[_*]")
# Words of the usual filler text.
FILLER = frozenset("lorem ipsum dolor sit amet consectetur consec tetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco ullam laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split())
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|(?<=。)")
_LATIN = re.compile(r"[a-z]+")
_INNER = re.compile(r"\w[/:_\-.()\\=@#|]\w|[\d/\\_=@#|{}<>\[\]]")
_EDGES = ".,;:!?()\"'“”«»—–-…。、"
#: Distinct words a worker remembers.
MEMO = 200_000
_hash = xxhash.xxh64_intdigest

ROWS = "id string, sort int, a long, b long, words string, n long, cover double"
#: Sorts of rows: residue by itself, a variable within a sentence, a fragment that may be a whole page, counts of a shape, and what a caller adds.
OF_ITSELF, VARIABLE, FRAGMENT, SHAPE, ADDED = range(5)


def filler(sentence: str) -> bool:
    words = _LATIN.findall(sentence.lower())
    return len(words) >= 5 and sum(w in FILLER for w in words) >= 0.6 * len(words)


def _key(shape: tuple) -> int:
    return _hash(" ".join(map(str, shape))) >> 1


class Shapes:
    """Shapes of sentences and their counts, as far as one partition has them."""

    def __init__(self) -> None:
        self.counts: dict[tuple, list] = {}
        self.words: dict[str, str] = {}

    def word(self, w: str) -> str:
        """A word without its edges; ``#`` for an identifier or number, ``N`` for a capitalised word."""
        got = self.words.get(w)
        if got is None:
            bare = w.strip(_EDGES)
            got = "#" if _INNER.search(w) else "N" if bare[:1].isupper() else bare
            if len(self.words) < MEMO:
                self.words[w] = got
        return got

    def keys(self, words: list[str]) -> tuple[tuple, tuple]:
        n, of = len(words), self.words
        first, last = words[0].lower(), words[-1]
        first, last = of.get(first) or self.word(first), of.get(last) or self.word(last)
        if n <= 3:
            return (n, ">", first), (n, "<", last)
        second, before = words[1], words[-2]
        return (n, ">", first, of.get(second) or self.word(second)), (n, "<", of.get(before) or self.word(before), last)

    def rows(self) -> Iterator[tuple]:
        yield from ((None, SHAPE, _key(a), None, None, n, c) for a, (n, c) in self.counts.items())
        self.counts.clear()

    def of_body(self, k: str, lines: list[str], keep: list[int]) -> Iterator[tuple]:
        """The rows of one main body; ``keep`` as of ``pages.Weights.keep``."""
        own = [(lines[pages.number(i)].strip(), i < 0) for i in keep]
        own = [(html.unescape(x), head) if "&" in x else (x, head) for x, head in own]
        content = sum(len(x) for x, head in own[1:] if not head)
        counts, is_filler = self.counts, FILLER.__contains__
        for i, (line, head) in enumerate(own):
            holds = _HOLDS.search(line) and PLACEHOLDER.search(line)
            for s in _SENTENCE.split(line):
                words = s.split()
                if not words:
                    continue
                if holds:
                    for m in PLACEHOLDER.finditer(s):
                        before, after = s[: m.start()].split(), s[m.end() :].split()
                        if len(before) + len(after) < AROUND:
                            yield k, OF_ITSELF, None, None, None, None, None
                        else:
                            around = " ".join([*map(self.word, before[-AROUND:]), "_", *map(self.word, after[:AROUND])])
                            yield k, VARIABLE, _hash(around) >> 1, None, None, None, None
                if sum(map(is_filler, words)) > 1 and filler(s):
                    yield k, OF_ITSELF, None, None, None, None, None
                if i:
                    cover = len(s) / (content + (len(s) if head else 0))
                    a, b = self.keys(words)
                    for x in (a, b):
                        got = counts.get(x)
                        if got is None:
                            counts[x] = [1, cover]
                        else:
                            got[0] += 1
                            got[1] += cover
                    if cover >= OWN:
                        yield k, FRAGMENT, _key(a), _key(b), " ".join(words), None, cover


Added = Callable[[str, list[str], list[int]], str | None]


def fragments(df: DataFrame, model: pages.Model, key: str = "id", text: str = "text", added: Added | None = None) -> DataFrame:
    """Rows of ``ROWS`` of all main bodies; of ``added(key, lines, keep)`` the result goes into ``words`` of a row ``ADDED``."""
    weights = model.weights

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        memo: dict[str, pages.Line] = {}
        shapes = Shapes()
        for k, t, rare in rows:
            if k is None or not t:
                continue
            lines, keep = pages.body_lines(t, weights.value, rare, memo)
            yield from shapes.of_body(k, lines, keep)
            if added is not None and (got := added(k, lines, keep)) is not None:
                yield k, ADDED, None, None, got, None, None
            if len(shapes.counts) > MEMO:
                yield from shapes.rows()
        yield from shapes.rows()

    return map_rows(spread(pages.with_rare(df, model, key, text)), [key, text, "rare"], ROWS, run)


def templates(found: DataFrame) -> DataFrame:
    """``shape, support, places, slots, cover``: whole-page templates, with the slots that aligning their records induces.

    Records of a shape are aligned by position; a position in which no word holds ``FIXED_SHARE`` of
    the records is a slot. Counted with partial aggregation, so a shape of very many records is no hot task.
    """
    shapes = found.where(F.col("sort") == SHAPE).groupBy(F.col("a").alias("shape")).agg(F.sum("n").alias("support"), (F.sum("cover") / F.sum("n")).alias("cover"))
    shapes = shapes.where((F.col("support") >= SUPPORT) & (F.col("cover") >= COVER))
    each = _of_shapes(found).join(shapes, "shape")
    words = each.select("shape", "support", "cover", F.posexplode("words").alias("at", "word")).groupBy("shape", "support", "cover", "at", "word").agg(F.count(F.lit(1)).alias("n"))
    place = words.groupBy("shape", "support", "cover", "at").agg((F.max("n") >= FIXED_SHARE * F.sum("n")).alias("fixed"))
    return place.groupBy("shape", "support", "cover").agg(F.count(F.lit(1)).alias("places"), F.count_if(~F.col("fixed")).alias("slots")).where(F.col("places") - F.col("slots") >= FIXED_PLACES * F.col("places"))


def _of_shapes(found: DataFrame) -> DataFrame:
    return found.where(F.col("sort") == FRAGMENT).select("id", F.explode(F.array("a", "b")).alias("shape"), F.split("words", " ").alias("words"))


def ids_of(found: DataFrame, key: str = "id") -> DataFrame:
    """``key``: distinct ids of the texts with residue, from a checkpoint of ``fragments``."""
    own = found.where(F.col("sort") == OF_ITSELF).select("id")
    whole = _of_shapes(found).join(templates(found).select("shape"), "shape", "left_semi").select("id")
    variables = found.where(F.col("sort") == VARIABLE).select("id", "a")
    spoken = variables.distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SPOKEN)
    left = variables.join(spoken, "a", "left_anti").select("id")
    return own.unionByName(whole).unionByName(left).distinct().withColumnRenamed("id", key)


def residue_ids(df: DataFrame, key: str = "id", text: str = "text", model: pages.Model | None = None) -> DataFrame:
    """``key``: distinct ids of texts whose main body holds residue.

    Null and empty texts, null ids and an empty table give no row; copies of a row give one.
    Only hashes of shapes and fragments that make up a tenth of a page are shuffled, never texts.
    """
    model = model or pages.fit(df, key, text)
    return ids_of(durable(fragments(df, model, key, text)), key)
