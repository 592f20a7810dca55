"""C4-style line quality, paragraph and bad-word filters, row-local and without Python.

Every filter adds ``<prefix>_reason`` (``''`` when kept); a null text stays null and has
reason null. The reason is the first that applies, in the documented order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import C4Paragraph, C4Quality
from ..functions import text as T


def candidate_lines(text: Column, cfg: C4Quality = C4Quality()) -> Column:
    """Lines that pass the shape tests, citations removed."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: T.trim_blank(T.strip_cr(x)))
    lines = F.filter(lines, lambda x: (x != "") & ~T.has_long_word(x, cfg.max_word_bytes))
    if cfg.remove_citations:
        lines = F.transform(lines, lambda x: F.when(F.contains(x, F.lit("[")), T.trim_blank(T.remove_citations(x))).otherwise(x))
    ok = lambda x: T.word_count(x) >= cfg.min_words_per_line
    if cfg.terminal_punctuation:
        return F.filter(lines, lambda x: (x != "") & T.ends_like_sentence(x) & ok(x))
    return F.filter(lines, lambda x: (x != "") & ok(x))


def _kind(line: Column, low: Column, cfg: C4Quality) -> Column:
    """What a candidate line does: keep, skip, or drop the document for a reason."""
    out = F.when(F.lit(False), F.lit(""))
    if cfg.lorem_ipsum:
        out = out.when(F.contains(low, F.lit("lorem ipsum")), F.lit("lorem_ipsum"))
    if cfg.javascript:
        out = out.when(F.contains(low, F.lit("javascript")), F.lit("skip"))
    if cfg.curly_bracket:
        out = out.when(F.contains(line, F.lit("{")), F.lit("curly_bracket"))
    if cfg.policy:
        for phrase in cfg.policy_phrases:
            out = out.when(F.contains(low, F.lit(phrase)), F.lit("skip"))
    return out.otherwise(F.lit("keep"))


def quality(df: DataFrame, text: str = "text", cfg: C4Quality = C4Quality(), prefix: str = "c4") -> DataFrame:
    """Adds ``<prefix>_reason`` and ``<prefix>_text`` (kept lines; the text as it was if dropped)."""
    marked, reason, kept = f"_{prefix}_lines", f"{prefix}_reason", f"_{prefix}_kept"
    # Lowered once a line: within a lambda nothing is shared between branches.
    lines = F.transform(candidate_lines(F.col(text), cfg), lambda x: F.struct(x.alias("line"), T.ascii_lower(x).alias("low")))
    lines = F.transform(lines, lambda x: F.struct(_kind(x["line"], x["low"], cfg).alias("kind"), x["line"].alias("line")))
    out = T.once(df, {marked: lines})
    event = F.get(F.filter(F.col(marked), lambda x: x["kind"].isin("lorem_ipsum", "curly_bracket")), F.lit(0))["kind"]
    out = out.withColumn(kept, F.transform(F.filter(F.col(marked), lambda x: x["kind"] == "keep"), lambda x: x["line"]))
    few = F.size(F.col(kept)) < cfg.min_sentences
    out = out.withColumn(reason, F.when(F.col(text).isNotNull(), F.coalesce(event, F.when(few, F.lit("too_few_sentences")), F.lit(""))))
    return out.withColumn(f"{prefix}_text", F.when(F.col(reason) == "", T.join_lines(F.col(kept))).otherwise(F.col(text))).drop(marked, kept)


def paragraph_reason(text: Column, cfg: C4Paragraph = C4Paragraph()) -> Column:
    """Too few lines, or the ``min_paragraphs``-th longest line too short (bytes)."""
    sizes = F.sort_array(F.transform(T.split_lines(text), F.octet_length), asc=False)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(F.size(sizes) < cfg.min_paragraphs, F.lit("< min_paragraphs"))
        .when(F.get(sizes, F.lit(cfg.min_paragraphs - 1)) < cfg.min_bytes, F.lit("top 3 paragraphs too short"))
        .otherwise(F.lit(""))
    )


#: Entries of one regex; longer lists take several, tried in the list's order.
ENTRIES_A_REGEX = 2_000


def bad_word_reason(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """``badword: <entry>`` of the first entry of the list (not of the text) that stands in it as a token.

    One zero-width regex finds all hits, overlapping ones too. Entries are not lowered, so
    one with an upper-case letter never matches; no entries keep everything.
    """
    entries = [w for w in words if w]
    usable = [w for w in dict.fromkeys(entries) if not any("A" <= ch <= "Z" for ch in w)]
    if not usable:
        return F.when(text.isNotNull(), F.lit(""))
    low = T.ascii_lower(text)
    found = []
    for at in range(0, len(usable), ENTRIES_A_REGEX):
        part = usable[at : at + ENTRIES_A_REGEX]
        # At one place the regex takes the first alternative that fits, which is the one wanted.
        hits = F.regexp_extract_all(low, F.lit(r"(?<![a-z0-9])(?=(" + "|".join(map(T.quote, part)) + r")(?![a-z0-9]))"), 1)
        # The intersection keeps the list's order and evaluates the regex once.
        found.append(F.get(F.array_intersect(F.array(*[F.lit(w) for w in part]), hits), F.lit(0)))
    return F.when(text.isNotNull(), F.coalesce(F.concat(F.lit("badword: "), F.coalesce(*found)), F.lit("")))


def bad_words_by_join(docs: DataFrame, entries: DataFrame, key: str, text: str = "text", entry: str = "entry", order: str = "entry_no") -> DataFrame:
    """``key, reason`` against a list too large for one regex: tokens are joined on equality.

    Entries of several words are matched on their first token, then checked in the text.
    The list is spread like any table; nothing is broadcast unless Catalyst finds it small.
    """
    usable = entries.select(F.col(order).alias("_no"), T.rtrim_entry(F.col(entry)).alias("_entry")).where((F.col("_entry") != "") & ~F.col("_entry").rlike("[A-Z]"))
    usable = usable.groupBy("_entry").agg(F.min("_no").alias("_no"))
    head = F.regexp_extract(F.col("_entry"), r"[a-z0-9]+|[^a-z0-9]+", 0)
    tokens = F.array_distinct(F.regexp_extract_all(T.ascii_lower(F.col(text)), F.lit(r"[a-z0-9]+|[^a-z0-9]"), 0))
    each = docs.where(F.col(text).isNotNull()).select(key, F.explode(tokens).alias("_head"))
    short = F.when(head.rlike("^[a-z0-9]"), head).otherwise(F.left(head, F.lit(1)))
    likely = each.join(usable.withColumn("_head", short), "_head").select(key, "_entry", "_no")
    checked = likely.join(docs.select(key, F.col(text).alias("_text")), key)
    pattern = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("_entry"), F.lit(r"\E(?![a-z0-9])"))
    first = checked.where(F.regexp(T.ascii_lower(F.col("_text")), pattern)).groupBy(key).agg(F.min_by("_entry", "_no").alias("_first"))
    out = docs.select(key, F.col(text).alias("_text")).join(first, key, "left")
    return out.select(key, F.when(F.col("_text").isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(F.concat(F.lit("badword: "), F.col("_first")), F.lit(""))).alias("reason"))


def read_bad_words(entries: list[str] | None) -> tuple[str, ...]:
    """Entries right-trimmed, blank ones left out; the fallback if there is no list at all (an empty list stays empty)."""
    from ..config import FALLBACK_BAD_WORDS

    if entries is None:
        return FALLBACK_BAD_WORDS
    return tuple(x for x in (e.rstrip(" \n\r\t") for e in entries) if x)
