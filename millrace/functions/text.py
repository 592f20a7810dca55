"""Byte- and ASCII-level text primitives as Column functions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six ASCII blanks and their complement, as regex classes (Java's \\v and \\s differ).
WS = r"[ \t\n\r\f\x0B]"
NWS = r"[^ \t\n\r\f\x0B]"
#: Where a word ends; a word of symbols alone after a blank; a line break and a line that opens with a bullet; a line's end with an
#: ellipsis. Possessive repeats keep them linear on any input.
WORD_END = r"(?![^ \t\n\r\f\x0B])"
SYMBOL_WORD = WS + r"([!-/:-@\[-`{-~]++)" + WORD_END
BULLET_LINE = r"\n[ \t\r\f\x0B]*+[-•]"
ELLIPSIS_LINE = r"(?:\.\.\.|…)[ \t\r\f\x0B]*+(?![^\n])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, _UPPER, _LOWER)


def strip_cr(c: Column) -> Column:
    """Without one trailing carriage return."""
    return F.when(F.endswith(c, F.lit("\r")), F.left(c, F.length(c) - 1)).otherwise(c)


def trim_blank(c: Column) -> Column:
    """Without blanks and tabs at either end."""
    return F.trim(c, F.lit(" \t"))


def rtrim_entry(c: Column) -> Column:
    """Without blanks, tabs and line ends behind."""
    return F.rtrim(c, F.lit(" \n\r\t"))


def split_lines(c: Column) -> Column:
    """Lines as a line reader yields them: a final newline opens no line, one CR before a line end goes, no text has no lines."""
    lines = F.split(F.regexp_replace(c, r"\n\z", ""), "\n", -1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.transform(lines, strip_cr))


def raw_lines(c: Column) -> Column:
    """Lines between newlines, a trailing empty one included."""
    return F.split(c, "\n", -1)


def words(c: Column) -> Column:
    """Maximal runs without ASCII blanks."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(NWS + "+"))


def has_long_word(c: Column, most: int) -> Column:
    """Whether a word has more than ``most`` bytes (never if ``most`` is -1)."""
    if most < 0:
        return F.lit(False)
    return (F.octet_length(c) > most) & F.exists(F.split(c, WS + "+"), lambda w: F.octet_length(w) > most)


def line_statistics(c: Column, most: int) -> Column:
    return F.struct(word_count(c).alias("word_count"), has_long_word(c, most).alias("has_long_word"))


def remove_citations(c: Column) -> Column:
    """One left-to-right pass over ``[citation needed]``, ``[edit]`` and ``[digits]`` (also ``[]``)."""
    return F.when(F.contains(c, F.lit("[")), F.regexp_replace(c, r"\[(?:citation needed|edit|[0-9]*)\]", "")).otherwise(c)


def ends_like_sentence(c: Column) -> Column:
    """Last byte is one of ``. ? ! " '`` and the end is no ``...``."""
    return F.right(c, F.lit(1)).isin(".", "?", "!", '"', "'") & ~F.endswith(c, F.lit("..."))


def count_hashes(c: Column) -> Column:
    return F.regexp_count(c, F.lit("#"))


def count_ellipses(c: Column) -> Column:
    """Non-overlapping ``...`` and ``…``."""
    return F.regexp_count(c, F.lit(r"\.\.\.|…"))


def has_non_punctuation(w: Column) -> Column:
    return w.rlike(r"[^!-/:-@\[-`{-~]")


def has_ascii_letter(w: Column) -> Column:
    return w.rlike("[A-Za-z]")


def starts_with_bullet(line: Column) -> Column:
    return line.rlike("^" + WS + "*[-•]")


def ends_with_ellipsis(line: Column) -> Column:
    return line.rlike(r"(?:\.\.\.|…)" + WS + r"*\z")


def has_token(c: Column, token: str) -> Column:
    """Whether ``token`` stands in ASCII-lowered ``c`` with no ASCII letter or digit beside it."""
    return ascii_lower(c).rlike(r"(?<![a-z0-9])" + quote(token) + r"(?![a-z0-9])")


def quote(s: str) -> str:
    """A literal inside a Java regex."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|&~#" else ch for ch in s)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def mib(size: Column) -> Column:
    return size / F.lit(1048576.0)


def rate(amount: Column, seconds: Column) -> Column:
    """Amount a second; 0 if no time passed."""
    return F.coalesce(F.try_divide(amount.cast("double"), seconds), F.lit(0.0))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row.

    A filter on a column defined by a long expression would have the optimizer copy that
    expression into the filter, and into each column built on it. A generator of one
    row keeps it in place; it is row-local and works on streams.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
