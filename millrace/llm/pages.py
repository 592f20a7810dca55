"""Problem 3: the main body of a page by its line-block distribution.

Markup is stripped line by line, the lengths of the lines are summed over a
sliding window, and the stretch of windows over a threshold is a first main
body. Over the whole corpus these stretches tell how each kind of line (its
length, the blanks that stripped tags leave, its ends) and each wording that
recurs in the texts lies: within the bodies or outside of them. The sums are then
taken of these weights instead of lengths: the cumulated weight has its surge
where the body begins and its dive where it ends, and with the new bodies the
weights are counted again. Where stripped block tags left single blanks (*seams*)
surge and dive are looked for at these, and the places where bodies of pages
of so many seams mostly lie have a weight too.

Within a body, a line is furniture if its wording recurs and stands outside of bodies
more than within, or if it opens with words that recur before titles and never
open a page (links to other pages).

Nothing here knows a phrase of any page; all weights are counts over all texts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charset
from .common import durable, map_rows, spread

#: Lines summed by the first sliding window, the sum that counts as text, and the share of the page's fullest window that does.
WINDOW = 3
SURGE = 180
SHARE = 0.35
#: Rounds of counting weights and laying bodies anew.
ROUNDS = 3
#: Times a wording must stand in the corpus to have a weight of its own.
RECUR = 5
#: Wordings sent to the workers; where more recur, the rarer ones are joined (``Model.rare``).
TABLE = 400_000
#: Most that one line weighs.
CLIP = 3.0
#: Most that may speak against a lead of links, as a share of what speaks for it.
AGAINST = 0.2
#: Lines below the headline that may be byline and dates.
HEADS = 4
#: From this length on a line is compared as it stands, without masking names and numbers.
LONG = 128
#: Distinct lines a worker remembers.
MEMO = 200_000

_TAG = re.compile(r"<[^>]*>")
_DIGITS = re.compile(r"\d+")
_LEAD = re.compile(r"([^\W\d_][^:：.!?0-9]{0,24}?) ?[:：] *(\S.*)", re.S)
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁĆČŁŃŚŠŹŻŽ"
_NAMES = re.compile(rf" [{_UPPER}][^ ぀-ヿ㐀-鿿]*(?: [{_UPPER}][^ ぀-ヿ㐀-鿿]*)*")
_ENDS = " \t\r\n»«.!:;·|→>"
_hash = xxhash.xxh64_intdigest


class Line(NamedTuple):
    """What is known of a line: its size, kind, hashed wording, hashed lead (0: none) whether a title follows the lead, and whether it credits pictures."""

    size: int
    kind: int
    word: int
    lead: int
    title: bool
    credit: bool


class Page(NamedTuple):
    """The non-blank lines of a text, their numbers, and before which of them there are seams."""

    numbers: list[int]
    lines: list[Line]
    cuts: list[int]


def masked(line: str) -> str:
    """A line's wording: numbers and capitalised words (but the first) are holes, ends and case do not count."""
    if "&" in line:
        line = html.unescape(line)
    made = _NAMES.sub(" N", " ".join(line.strip(_ENDS).split())).lower()
    return _DIGITS.sub("0", made) if _DIGITS.search(made) else made


class _Sorts(dict):
    """What a character at the end of a line is: lower case, upper case, other letter, digit, end of a sentence, other."""

    def __missing__(self, c: str) -> int:
        got = 0 if c.islower() else 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".?!。" else 5
        self[c] = got
        return got


_sorts = _Sorts()
#: Twice the binary logarithm of a size, by size.
_LOGS = [int(2 * math.log2(n + 1)) for n in range(4096)]


def line_of(raw: str, memo: dict[str, Line] | None = None) -> Line:
    if memo is not None:
        known = memo.get(raw)
        if known is not None:
            return known
    bare = raw.strip()
    n = len(bare)
    lead, trail = len(raw) - len(raw.lstrip()), len(raw.rstrip("\r")) - len(raw.rstrip())
    gaps = bare.count("   ")
    kind = _LOGS[n] if n < 4096 else int(2 * math.log2(n + 1))
    kind = (((kind * 5 + (lead if lead < 4 else 4)) * 5 + (trail if trail < 4 else 4)) * 6 + _sorts[bare[0]]) * 6 + _sorts[bare[-1]]
    kind = kind * 4 + (gaps if gaps < 3 else 3)
    if n >= LONG:
        return Line(n, kind, (_hash(bare) >> 1) or 1, 0, False, False)
    word = masked(bare)
    m = _LEAD.match(bare)
    found = Line(n, kind, (_hash(word) >> 1) or 1, (_hash(m[1].lower()) >> 1) or 1 if m else 0, bool(m) and len(m[2]) >= 20 and m[2][-1].isalpha(), is_credit(bare))
    if memo is not None and len(memo) < MEMO:
        memo[raw] = found
    return found


def page_of(lines: list[str], memo: dict[str, Line] | None = None) -> Page:
    numbers, out, cuts = [], [], []
    for i, raw in enumerate(lines):
        if raw == " " or raw == " \r":
            cuts.append(len(out))
        elif raw and not raw.isspace():
            numbers.append(i)
            out.append(line_of(raw, memo))
    return Page(numbers, out, cuts)


def surge(sizes: list[int]) -> tuple[int, int]:
    """The longest stretch ``[first, last)`` whose windows hold text; the ends short of it are cut."""
    n = len(sizes)
    total = [0, *accumulate(sizes)]
    sums = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    least = max(min(SURGE, max(sums)), SHARE * max(sums))
    best, i = (0, 0), 0
    while i < n:
        j = i
        while j < n and sums[j] >= least:
            j += 1
        if j > i and total[min(n, j + WINDOW - 1)] - total[i] > total[best[1]] - total[best[0]]:
            best = i, min(n, j + WINDOW - 1)
        i = j + 1
    first, last = best
    small = 0.8 * least / WINDOW
    while first < last - 1 and sizes[first] < small:
        first += 1
    while last > first + 1 and sizes[last - 1] < small:
        last -= 1
    return first, last


def layout(at: list[int], span: tuple[int, int]) -> str | None:
    """``parts, first, last``: which of a page's parts (between the places ``at``) a body takes; None if it does not begin and end there."""
    for a in range(len(at) - 1):
        for b in range(a + 1, len(at)):
            if (at[a], at[b]) == span:
                return f"{len(at) - 1},{a},{b}"
    return None


def first_span(sizes: list[int], cuts: list[int]) -> tuple[int, int]:
    """Body by the windows of line lengths; of a page with seams the part with most of it, else with the head lines above."""
    if not sizes:
        return 0, 0
    first, last = surge(sizes)
    if not cuts:
        return max(0, first - HEADS), last
    at = [0, *cuts, len(sizes)]
    _, _, a, b = max((sum(sizes[max(a, first) : min(b, last)]), -a, a, b) for a, b in zip(at, at[1:], strict=False))
    return a, b


@dataclass
class Weights:
    """Weights of kinds of lines, wordings and layouts (log of times inside to times outside), and leads of links."""

    kinds: dict[int, float] = field(default_factory=dict)
    words: dict[int, float] = field(default_factory=dict)
    layouts: dict[str, float] = field(default_factory=dict)
    leads: frozenset[int] = frozenset()

    def of(self, page: Page, rare: dict[int, float] | None = None) -> list[float | None]:
        """Weight of the wording of each line, None if it has none of its own."""
        words = self.words
        got = [words.get(x.word) for x in page.lines]
        for i, w in (rare or {}).items():
            got[i] = w
        return got

    def span(self, page: Page, own: list[float | None]) -> tuple[int, int]:
        """Body between the surge and the dive of the cumulated weights."""
        kinds = self.kinds
        each = [max(-CLIP, min(CLIP, kinds.get(x.kind, 0.0) if w is None else w)) for x, w in zip(page.lines, own, strict=True)]
        return self.lay([0.0, *accumulate(each)], page.cuts, any(w is not None and w < -1 for w in own))

    def lay(self, total: list[float], cuts: list[int], framed: bool) -> tuple[int, int]:
        """``total``: the weights cumulated; ``framed``: whether some wording is one that stands outside of bodies."""
        n = len(total) - 1
        best, most = (0, n), -math.inf
        if cuts and len(cuts) <= 10:
            at = [0, *cuts, n]
            for a in range(len(at) - 1):
                for b in range(a + 1, len(at)):
                    size = at[b] - at[a]
                    if size:
                        t = (total[at[b]] - total[at[a]]) / math.sqrt(size) + self.layouts.get(f"{len(at) - 1},{a},{b}", -4.0)
                        if t > most:
                            best, most = (at[a], at[b]), t
            return best
        if not cuts and not framed:
            return 0, n  # an article without a page around it
        low, start = 0.0, 0
        for i in [0, *cuts, n] if cuts else range(n + 1):
            if i > start and total[i] - low > most:
                best, most = (start, i), total[i] - low
            if total[i] < low:
                low, start = total[i], i
        return best

    def keep(self, page: Page, rare: dict[int, float] | None = None) -> list[int]:
        """Numbers (among the text's lines) of the main body's lines; byline and dates as ``-1 - number``."""
        if not page.lines:
            return []
        own = self.of(page, rare)
        first, last = self.span(page, own)
        out = []
        for i in range(first, last):
            w, line, number = own[i], page.lines[i], page.numbers[i]
            if i > first and (w is not None and w < 0 or line.lead in self.leads and line.title):
                continue
            out.append(-1 - number if first < i <= first + HEADS and w is not None and w > 0 and line.size < SURGE // 2 and len(out) == i - first and (i == first + 1 or out[-1] < 0) else number)
        if last < len(page.lines) and page.lines[last].credit:
            out.append(page.numbers[last])  # a picture credit belongs to the article though it may stand right below it
        return out


@dataclass
class Model:
    """The corpus' weights; ``rare``: ``uid, weights MAP<INT, DOUBLE>`` of the lines whose wordings the table does not hold, if there are any."""

    weights: Broadcast
    rare: DataFrame | None = None


_PAGES = "uid long, numbers array<int>, sizes array<int>, kinds array<int>, words array<long>, leads array<long>, titles array<boolean>, credits array<boolean>, cuts array<int>"


def _uid(key: str, text: str) -> F.Column:
    return F.xxhash64(F.col(key), F.col(text))


def described(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row of numbers for each text that is not null or empty: what all further steps read instead of the text."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        memo: dict[str, Line] = {}
        for k, uid, t in rows:
            page = page_of(t.split("\n"), memo)
            columns = list(zip(*page.lines, strict=True)) or [()] * 6
            yield k, uid, page.numbers, *columns, page.cuts

    source = spread(df.where((F.col(text) != "") & F.col(key).isNotNull()).select(key, _uid(key, text).alias("uid"), text))
    return map_rows(source, [key, "uid", text], f"`{key}` string, {_PAGES}", run)


def _page(numbers: list[int], *rest: list) -> Page:
    return Page(numbers, [Line(*x) for x in zip(*rest[:-1], strict=True)], rest[-1])


_COLUMNS = ["numbers", "sizes", "kinds", "words", "leads", "titles", "credits", "cuts"]


class _Batch:
    """The pages of one Arrow batch as flat arrays: ``starts[i]:starts[i + 1]`` are the lines of page ``i``."""

    def __init__(self, batch: pa.RecordBatch):
        self.pages = batch.num_rows
        lists = [batch.column(i) for i in range(batch.num_columns)]
        self.starts = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
        self.sizes, self.kinds, self.words, self.leads, self.titles = (x.flatten().to_numpy(zero_copy_only=False) for x in lists[:5])
        cuts = lists[5].offsets.to_numpy()
        flat = lists[5].flatten().to_numpy(zero_copy_only=False).tolist()
        self.cuts = [flat[a - cuts[0] : b - cuts[0]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def spans(self, weights: Weights | None, table: np.ndarray, each: np.ndarray, kinds: np.ndarray, at: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Body ``first, last`` of each page (counted from the page's first line), and its seams."""
        if weights is None:
            for i in range(self.pages):
                yield *first_span(self.sizes[self.starts[i] : self.starts[i + 1]].tolist(), self.cuts[i]), self.cuts[i]
            return
        own = np.where(hit, each[at] if len(each) else 0.0, kinds[self.kinds])
        total = np.concatenate([[0.0], np.cumsum(np.clip(own, -CLIP, CLIP))])
        framed = np.concatenate([[0], np.cumsum(hit & (own < -1))])
        for i in range(self.pages):
            a, b = self.starts[i], self.starts[i + 1]
            yield *weights.lay((total[a : b + 1] - total[a]).tolist(), self.cuts[i], bool(framed[b] > framed[a])), self.cuts[i]


#: Kinds of lines that ``line_of`` can tell.
KINDS = 64 * 5 * 5 * 6 * 6 * 4


def counted(pages: DataFrame, known: Broadcast, weights: Broadcast | None) -> DataFrame:
    """``sort, key, inside, outside`` of kinds, known wordings, layouts and leads under the present bodies, summed per partition first.

    Of a lead, ``inside`` counts title lines within bodies that hold a long line, ``outside`` those that speak against a link.
    """
    schema = "sort string, key long, inside long, outside long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        w = weights.value if weights is not None else None
        each = np.array([w.words.get(x, np.nan) for x in table.tolist()]) if w else np.zeros(0)
        of_kind = np.zeros(KINDS)
        if w:
            of_kind[list(w.kinds)] = list(w.kinds.values())
        kinds = np.zeros((2, KINDS), np.int64)
        words = np.zeros((2, len(table)), np.int64)
        places: Counter[str] = Counter()
        leads: list[Counter[int]] = [Counter(), Counter()]
        for batch in batches:
            b = _Batch(batch)
            at = np.minimum(np.searchsorted(table, b.words), max(0, len(table) - 1))
            hit = table[at] == b.words if len(table) else np.zeros(len(b.words), bool)
            weighed = hit & ~np.isnan(each[at]) if len(each) else np.zeros(len(b.words), bool)
            inside, article = np.zeros(len(b.words), bool), np.zeros(len(b.words), bool)
            for i, (first, last, cuts) in enumerate(b.spans(w, table, each, of_kind, at, weighed)):
                start = b.starts[i]
                if cuts and (place := layout([0, *cuts, int(b.starts[i + 1] - start)], (first, last))):
                    places[place] += 1
                inside[start + first : start + last] = True
                if b.sizes[start + first : start + last].max(initial=0) >= SURGE // 2:
                    article[start + first + 1 : start + last] = True
            for j, which in enumerate((inside, ~inside)):
                kinds[j] += np.bincount(b.kinds[which], minlength=KINDS)
                if len(table):
                    words[j] += np.bincount(at[which & hit], minlength=len(table))
            links = article & b.titles
            for j, which in enumerate((links, ~links)):
                leads[j].update(b.leads[which & (b.leads != 0)].tolist())
            if len(leads[0]) + len(leads[1]) > MEMO:
                yield _counts("lead", *leads)
                leads = [Counter(), Counter()]
        yield _counts("kind", *({k: int(x[k]) for k in np.flatnonzero(x).tolist()} for x in kinds))
        yield _counts("word", *({int(table[k]): int(x[k]) for k in np.flatnonzero(x).tolist()} for x in words))
        yield _counts("lead", *leads)
        for place, n in places.items():
            yield _counts("layout:" + place, {0: n}, {})

    each = pages.select("sizes", "kinds", "words", "leads", "titles", "cuts").mapInArrow(run, schema)
    return each.groupBy("sort", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))


def _counts(sort: str, inside: dict[int, int], outside: dict[int, int]) -> pa.RecordBatch:
    keys = list(inside.keys() | outside.keys())
    columns = [[sort] * len(keys), keys, [inside.get(k, 0) for k in keys], [outside.get(k, 0) for k in keys]]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["sort", "key", "inside", "outside"])


def weights_of(counts: Iterable[tuple]) -> Weights:
    kinds, words, places, leads = {}, {}, Counter(), set()
    for sort, k, inside, outside in counts:
        if sort == "kind":
            kinds[k] = math.log((inside + 1) / (outside + 1))
        elif sort == "word":
            words[k] = math.log((inside + 0.5) / (outside + 0.5))
        elif sort == "lead":
            leads.add(k)
        else:
            places[sort.partition(":")[2]] += inside
    totals: Counter[str] = Counter()
    for at, n in places.items():
        totals[at.partition(",")[0]] += n
    layouts = {at: math.log((n + 0.5) / (totals[at.partition(",")[0]] - n + 0.5)) for at, n in places.items()}
    return Weights(kinds, words, layouts, frozenset(leads))


def learn(pages: DataFrame, table: int = TABLE) -> Model:
    """Weights counted over all of ``described`` pages (a checkpoint, as it is read in each round).

    The wordings sent to the workers are those that recur; if these are more than
    ``table``, the most frequent ones, and the others get their weights by a join at the end.
    """
    sc = pages.sparkSession.sparkContext
    often = durable(pages.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RECUR))
    many = often.count() > table
    top = often.orderBy(F.desc("n"), "word").limit(table) if many else often
    known = sc.broadcast(np.sort(top.select("word").toArrow()["word"].to_numpy()))
    weights: Broadcast | None = None
    for _ in range(ROUNDS):
        # A lead needs title lines within bodies, and next to nothing that speaks against it; there are few such.
        lead = (F.col("sort") == "lead") & (F.col("inside") >= RECUR) & (F.col("outside") <= AGAINST * F.col("inside"))
        counts = counted(pages, known, weights).where(lead | (F.col("sort") != "lead")).toArrow()
        weights = sc.broadcast(weights_of(zip(*(counts[c].to_pylist() for c in counts.column_names), strict=True)))
    return Model(weights, _rare(pages, often, top, weights) if many else None)


def _rare(pages: DataFrame, often: DataFrame, top: DataFrame, weights: Broadcast) -> DataFrame:
    """Weights of the lines whose wordings recur but are not in the table, by a shuffle on the wording."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for uid, *row in rows:
            page = _page(*row)
            if page.lines:
                first, last = weights.value.span(page, weights.value.of(page))
                yield from ((uid, i, x.word, int(first <= i < last)) for i, x in enumerate(page.lines))

    lines = map_rows(pages, ["uid", *_COLUMNS], "uid long, i int, word long, inside int", run)
    lines = durable(lines.join(often.join(top, "word", "left_anti").select("word"), "word", "left_semi"))
    each = lines.groupBy("word").agg(F.sum("inside").alias("a"), F.count(F.lit(1)).alias("n"))
    each = each.select("word", F.log((F.col("a") + 0.5) / (F.col("n") - F.col("a") + 0.5)).alias("w"))
    held = lines.join(each, "word").select("uid", "i", "w").distinct()
    return durable(held.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("rare")))


def fit(df: DataFrame, key: str = "id", text: str = "text", table: int = TABLE) -> Model:
    """``learn`` over a table of texts; an empty table gives a model without weights (then a text is all body)."""
    return learn(durable(described(df, key, text)), table)


def with_rare(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """The rows of ``key, text`` with the column ``rare`` (null where the model's table holds all wordings)."""
    if model.rare is None:
        return df.select(key, text, F.lit(None).cast("map<int,double>").alias("rare"))
    return df.select(key, text, _uid(key, text).alias("uid")).join(model.rare, "uid", "left").select(key, text, "rare")


def body_lines(text: str, weights: Weights, rare=None, memo: dict[str, Line] | None = None) -> tuple[list[str], list[int]]:
    """All lines of a text, and the numbers of those that make the main body (``Weights.keep``)."""
    lines = text.split("\n")
    return lines, weights.keep(page_of(lines, memo), dict(rare) if rare else None)


def is_credit(line: str) -> bool:
    """Whether a line credits pictures to somebody."""
    return " by " in line and bool(re.search(r"(?i)\b(?:pictures?|photos?|images?) by \S", line))


def number(k: int) -> int:
    return k if k >= 0 else -1 - k


def main_body(text: str, weights: Weights, rare=None, memo: dict[str, Line] | None = None) -> str:
    lines, keep = body_lines(text, weights, rare, memo)
    return "\n".join(lines[number(k)].strip() for k in keep)


def strip_markup(page: str) -> str:
    """Each tag becomes a blank; an unclosed tag at the end is cut. Line breaks stay."""
    return re.sub(r"<[^>]*\Z", "", _TAG.sub(lambda m: " " + "\n" * m[0].count("\n"), page))


def bodies(df: DataFrame, key: str = "id", text: str = "text", key_type: str = "string", model: Model | None = None) -> DataFrame:
    """``key, body``: the main body of every row's text (null for null, empty for empty)."""
    model = model or fit(df, key, text)
    weights = model.weights

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        memo: dict[str, Line] = {}
        for k, t, rare in rows:
            yield k, None if t is None else main_body(t, weights.value, rare, memo)

    return map_rows(spread(with_rare(df, model, key, text)), [key, text, "rare"], f"`{key}` {key_type}, body string", run)


def record_bodies(records: DataFrame, model: charset.Model | None = None) -> DataFrame:
    """``path, ordinal, id, body`` of the response records of a crawl: header cut, bytes decoded, markup stripped, body kept.

    With a ``model`` of ``charset`` the charset of bytes that are no UTF-8 is chosen by the words they make.
    """
    table = model.table if model else None

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        channel = charset._channel(table) if table else None
        for path, ordinal, i, content, extra in rows:
            yield path, ordinal, i, None if content is None else strip_markup(charset.decode(content, charset._for(channel, extra)))

    texts = map_rows(spread(charset.contents(records, model)), ["path", "ordinal", "id", "content", "extra"], "path string, ordinal long, id string, text string", run)
    texts = durable(texts.withColumn("at", F.to_json(F.struct("path", "ordinal"))))
    found = bodies(texts, "at")
    return found.select(F.from_json("at", "path string, ordinal long").alias("r"), "body").select("r.*", "body").join(texts.select("path", "ordinal", "id"), ["path", "ordinal"]).select("path", "ordinal", "id", "body")


def outside(df: DataFrame, key: str = "id", text: str = "text", pages: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """``key, line_no INT``: the non-white lines of each text that are not in its main body.

    Null and empty texts and null keys have no rows; copies of a row count once. Texts are read once, by
    ``described`` (``pages``, if the caller has it); what is shuffled to remove copies is one list of numbers a text.
    """
    pages = pages if pages is not None else durable(described(df, key, text))
    model = model or learn(pages)
    weights = model.weights
    source = pages.select(key, *_COLUMNS, F.lit(None).cast("map<int,double>").alias("rare")) if model.rare is None else pages.join(model.rare, "uid", "left").select(key, *_COLUMNS, "rare")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, *row, rare in rows:
            page = _page(*row)
            inside = set(map(number, weights.value.keep(page, dict(rare) if rare else None)))
            out = [i for i in page.numbers if i not in inside]
            if out:
                yield k, out

    rows = map_rows(source, [key, *_COLUMNS, "rare"], f"`{key}` string, _lines array<int>", run)
    return rows.dropDuplicates([key, "_lines"]).select(key, F.explode("_lines").alias("line_no")).distinct()
