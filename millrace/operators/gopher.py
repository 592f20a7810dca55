"""Gopher-style document quality: metrics as one projection, the verdict as an ordered choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Gopher
from ..functions import text as T

METRICS = ("n_words", "n_real_words", "real_bytes", "alpha_words", "stop_words", "hashes", "ellipses", "n_lines", "bullet_lines", "ellipsis_lines")


def metrics(df: DataFrame, text: str = "text", cfg: Gopher = Gopher(), prefix: str = "") -> DataFrame:
    """Adds the counts of ``METRICS`` (LONG). Null texts have null counts.

    Words are split once; words of nothing but symbols are found by one pass and taken
    off the totals, and line and stop-word counts are single passes over the text
    instead of a function call a word. Stop words are case-sensitive occurrences.
    """
    t, w, symbols = F.col(text), f"_{prefix}words", f"_{prefix}symbols"
    # With a blank or line break before it, a word or line is found by that character instead of by looking back at each place.
    spaced, broken = F.concat(F.lit(" "), t), F.concat(F.lit("\n"), t)
    out = T.once(df, {w: T.words(t), symbols: F.regexp_extract_all(spaced, F.lit(T.SYMBOL_WORD), 1)})
    words = F.col(w)
    stops = "|".join(T.quote(x) for x in cfg.stop_words)
    counts = {
        "n_words": F.size(words),
        "n_real_words": F.size(words) - F.size(F.col(symbols)),
        "real_bytes": F.octet_length(F.translate(t, " \t\n\r\f\x0b", "")) - F.octet_length(F.array_join(F.col(symbols), "")),
        "alpha_words": F.size(F.filter(words, T.has_ascii_letter)),
        "stop_words": F.regexp_count(spaced, F.lit(f"{T.WS}(?:{stops}){T.WORD_END}")) if stops else F.lit(0),
        "hashes": T.count_hashes(t),
        "ellipses": T.count_ellipses(t),
        "n_lines": F.regexp_count(t, F.lit("\n")) + 1,
        "bullet_lines": F.regexp_count(broken, F.lit(T.BULLET_LINE)),
        "ellipsis_lines": F.regexp_count(t, F.lit(T.ELLIPSIS_LINE)),
    }
    return T.once(out, {prefix + k: F.when(t.isNotNull(), v).cast("long") for k, v in counts.items()}).drop(w, symbols)


def reason(cfg: Gopher = Gopher(), prefix: str = "") -> Column:
    """The first failing check over the columns of :func:`metrics`; ``''`` if none, null for a null text.

    Ratios are doubles and comparisons strict; a zero parameter switches its check off.
    """
    m = {k: F.col(prefix + k) for k in METRICS}
    n, real = m["n_words"].cast("double"), m["n_real_words"]
    avg = F.when(real == 0, F.lit(0.0)).otherwise(F.try_divide(m["real_bytes"].cast("double"), real.cast("double")))
    lines = m["n_lines"].cast("double")
    checks: list[tuple[Column, str]] = [(m["n_words"] == 0, "gopher_short_doc")]
    if cfg.min_words:
        checks.append((real < cfg.min_words, "gopher_short_doc"))
    if cfg.max_words:
        checks.append((real > cfg.max_words, "gopher_long_doc"))
    if cfg.min_avg_bytes:
        checks.append((avg < cfg.min_avg_bytes, "gopher_below_avg_threshold"))
    if cfg.max_avg_bytes:
        checks.append((avg > cfg.max_avg_bytes, "gopher_above_avg_threshold"))
    if cfg.max_symbol_ratio:
        checks.append((F.try_divide(m["hashes"].cast("double"), n) > cfg.max_symbol_ratio, "gopher_too_many_hashes"))
        checks.append((F.try_divide(m["ellipses"].cast("double"), n) > cfg.max_symbol_ratio, "gopher_too_many_ellipsis"))
    if cfg.max_bullet_ratio:
        checks.append((F.try_divide(m["bullet_lines"].cast("double"), lines) > cfg.max_bullet_ratio, "gopher_too_many_bullets"))
    if cfg.max_ellipsis_line_ratio:
        checks.append((F.try_divide(m["ellipsis_lines"].cast("double"), lines) > cfg.max_ellipsis_line_ratio, "gopher_too_many_end_ellipsis"))
    if cfg.min_alpha_ratio:
        checks.append((F.try_divide(m["alpha_words"].cast("double"), n) < cfg.min_alpha_ratio, "gopher_below_alpha_threshold"))
    if cfg.min_stop_words:
        checks.append((m["stop_words"] < cfg.min_stop_words, "gopher_enough_stop_words"))
    out = F.when(m["n_words"].isNull(), F.lit(None).cast("string"))
    for test, why in checks:
        out = out.when(test, F.lit(why))
    return out.otherwise(F.lit(""))


def quality(df: DataFrame, text: str = "text", cfg: Gopher = Gopher()) -> DataFrame:
    """Adds ``gopher_reason``; the counts themselves are dropped."""
    p = "_gopher_"
    return metrics(df, text, cfg, p).withColumn("gopher_reason", reason(cfg, p)).drop(*(p + k for k in METRICS))


def verdict(text_reason: Column) -> Column:
    """``keep<TAB>`` or ``drop<TAB>reason``, as the command line prints it."""
    return F.concat(F.when(text_reason == "", F.lit("keep")).otherwise(F.lit("drop")), F.lit("\t"), text_reason)
