"""Planned steps of the pipeline beyond its filters: URL and language filters, repetition and web-text ratios, formatting
of personal data, and near-duplicate removal by MinHash. All but the last are row-local expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import durable

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """Lower-case host of a URL without user and port; null if there is none."""
    found = F.regexp_extract(url, HOST, 1)
    return F.when(found != "", F.lower(found))


def url_filter(df: DataFrame, blocked: DataFrame, url: str = "url", entry: str = "host") -> DataFrame:
    """Rows whose host is not on the list; rows without a host stay. The list is broadcast only if Catalyst finds it small."""
    hosts = blocked.select(F.lower(F.col(entry)).alias("_host")).where("_host IS NOT NULL").distinct()
    return df.withColumn("_host", host(F.col(url))).join(hosts, "_host", "left_anti").drop("_host")


# Frequent function words by language.
LANGUAGE_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be"),
    "es": ("el", "la", "los", "las", "que", "del", "por", "para", "con", "una", "más", "no"),
    "de": ("der", "die", "das", "und", "nicht", "ist", "mit", "von", "dem", "ein", "auch", "den"),
    "fr": ("le", "les", "des", "est", "dans", "pour", "une", "pas", "que", "du", "et", "il"),
    "ru": ("и", "в", "не", "на", "что", "с", "по", "как", "это", "а", "к", "для"),
}
#: Share of kana among the characters from which a text is Japanese.
KANA_SHARE = 0.1


def language(text: Column) -> Column:
    """The language most of whose function words stand in a text (ties: the first of the table), ``ja`` by its kana, ``''`` if none do; null for null."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)
    count = lambda own: F.size(F.filter(words, lambda w: w.isin(*own)))
    scores = F.array(*map(count, LANGUAGE_WORDS.values()))
    kana = F.regexp_count(text, F.lit("[ぁ-ゟ゠-ヿ]"))
    best = F.get(F.array(*map(F.lit, LANGUAGE_WORDS)), F.array_position(scores, F.array_max(scores)).cast("int") - 1)
    return F.when(text.isNull(), F.lit(None).cast("string")).when((text != "") & (kana > KANA_SHARE * F.char_length(text)), F.lit("ja")).when(F.array_max(scores) == 0, F.lit("")).otherwise(best)


def language_filter(df: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """Adds ``language`` and leaves rows of the languages to keep; null texts go."""
    return T.once(df, {"language": language(F.col(text))}).where(F.col("language").isin(*keep))


def _top_gram(words: Column, n: int) -> Column:
    """Characters of the most frequent run of ``n`` words times its count (of equally frequent ones the longest); 0 if none stands twice."""
    grams = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    start = F.struct(F.lit("").alias("g"), F.lit(0).alias("n"), F.lit(1).alias("most"), F.lit(0).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(acc["g"] == x, acc["n"] + 1).otherwise(F.lit(1))
        size = F.char_length(x)
        better = (n > acc["most"]) | ((n == acc["most"]) & (n > 1) & (size > acc["size"]))
        return F.struct(x.alias("g"), n.alias("n"), F.when(better, n).otherwise(acc["most"]).alias("most"), F.when(better, size).otherwise(acc["size"]).alias("size"))

    return F.aggregate(F.array_sort(grams), start, step, lambda acc: acc["most"] * acc["size"])


def _chars(parts: Column) -> Column:
    return F.char_length(F.array_join(parts, ""))


REPETITION = ("lines", "duplicate_lines", "line_chars", "duplicate_line_chars", "paragraphs", "duplicate_paragraphs", "chars", "top_2_chars", "top_3_chars", "top_4_chars")


def repetition(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of ``REPETITION`` (LONG): repeated lines and paragraphs (beyond the first of each), and characters of the
    most frequent runs of two to four words. Null texts have null counts. Row-local."""
    t = F.col(text)
    filled = lambda sep: F.filter(F.transform(F.split(t, sep), T.trim_blank), lambda x: x != "")
    out = T.once(df, {"_lines": filled("\n"), "_paragraphs": filled("\n\n+"), "_words": T.words(t)})
    lines, paragraphs, words = F.col("_lines"), F.col("_paragraphs"), F.col("_words")
    counts = {
        "lines": F.size(lines),
        "duplicate_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "line_chars": _chars(lines),
        "duplicate_line_chars": _chars(lines) - _chars(F.array_distinct(lines)),
        "paragraphs": F.size(paragraphs),
        "duplicate_paragraphs": F.size(paragraphs) - F.size(F.array_distinct(paragraphs)),
        "chars": F.char_length(t),
        **{f"top_{n}_chars": _top_gram(words, n) for n in (2, 3, 4)},
    }
    return T.once(out, {k: F.when(t.isNotNull(), v).cast("long") for k, v in counts.items()}).drop("_lines", "_paragraphs", "_words")


#: Most of each ratio, in order of testing: repeated parts of all parts, characters of the top run of words of all characters.
REPETITION_LIMITS = (("duplicate_lines", "lines", 0.30), ("duplicate_paragraphs", "paragraphs", 0.30), ("duplicate_line_chars", "line_chars", 0.20), ("top_2_chars", "chars", 0.20), ("top_3_chars", "chars", 0.18), ("top_4_chars", "chars", 0.16))


def repetition_reason(limits: tuple[tuple[str, str, float], ...] = REPETITION_LIMITS) -> Column:
    """The first ratio over its limit, ``''`` if none; null for a null text."""
    out = F.when(F.col("chars").isNull(), F.lit(None).cast("string"))
    for part, whole, most in limits:
        out = out.when(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")) > most, F.lit(part))
    return out.otherwise(F.lit(""))


def web_text_reason(text: Column, punctuated: float = 0.12, short: float = 0.67, short_chars: int = 30, repeated: float = 0.01, breaks: float = 0.3) -> Column:
    """Why a text's lines are not those of web prose: too few end in punctuation, too many are short, too many characters are of
    repeated lines, too many line breaks a word; ``''`` if none of these, null for null."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.trim_blank), lambda x: x != "")
    n = F.size(lines).cast("double")
    ends = F.size(F.filter(lines, lambda x: F.right(x, F.lit(1)).isin(".", "!", "?", '"', "'"))).cast("double")
    few = F.size(F.filter(lines, lambda x: F.char_length(x) < short_chars)).cast("double")
    all_chars, distinct = _chars(lines).cast("double"), _chars(F.array_distinct(lines)).cast("double")
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(n == 0, F.lit("no_lines"))
        .when(ends / n < punctuated, F.lit("line_punctuation"))
        .when(few / n > short, F.lit("short_lines"))
        .when(F.try_divide(all_chars - distinct, all_chars) > repeated, F.lit("repeated_lines"))
        .when(F.try_divide(F.regexp_count(text, F.lit("\n")).cast("double"), T.word_count(text).cast("double")) > breaks, F.lit("line_breaks"))
        .otherwise(F.lit(""))
    )


# What mail addresses and IPv4 addresses look like.
MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b"


def format_personal(text: Column, mail: str = "email@example.com", ip: str = "192.0.2.1") -> Column:
    """Mail and IPv4 addresses replaced by stated ones."""
    return F.regexp_replace(F.regexp_replace(text, MAIL, mail), IPV4, ip)


#: Words of a shingle; bands of the signature and hashes in each: documents of similarity 0.8 share a band in 0.998 of the cases.
SHINGLE = 5
BANDS = 16
ROWS = 5


def signatures(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, signature``: minima of ``BANDS * ROWS`` hashes over the shingles of a text's lower-case words (one of all words, if these
    are fewer than ``SHINGLE``). Texts without a word have none. Whole texts, no Python."""
    words = T.words(F.lower(F.col(text)))
    out = T.once(df.select(key, F.col(text)), {"_words": words}).where(F.size("_words") > 0)
    last = F.greatest(F.lit(1), F.size("_words") - (SHINGLE - 1))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice("_words", i, F.lit(SHINGLE)), " "))))
    out = T.once(out.select(key, "_words"), {"_hashes": shingles})
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda k: F.array_min(F.transform("_hashes", lambda h: F.xxhash64(h, k))))
    return out.select(key, each.alias("signature"))


def near_duplicates(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, cluster``: signature, buckets, clusters. Documents that share a band are of one class; its number is the least key.

    One row a row; documents without a word are classes of their own, null keys are left out. No pair is ever written: a bucket takes
    the least label of its documents and a document that of its buckets, until nothing changes. Hashes are shuffled, never texts.
    """
    keyed = df.where(F.col(key).isNotNull())
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * ROWS + 1, F.lit(ROWS))))
    member = signatures(keyed, key, text).select(F.col(key).alias("_doc"), F.explode(buckets).alias("_bucket")).distinct()
    shared = member.groupBy("_bucket").agg(F.min("_doc").alias("a"), F.max("_doc").alias("b")).where("a <> b").select("_bucket")
    member = durable(member.join(shared, "_bucket"))
    labels = durable(member.groupBy("_doc").agg(F.min("_doc").alias("cluster")))
    while True:
        low = member.join(labels, "_doc").groupBy("_bucket").agg(F.min("cluster").alias("low"))
        near = member.join(low, "_bucket").groupBy("_doc").agg(F.min("low").alias("low"))
        new = durable(near.join(labels, "_doc").select("_doc", F.col("cluster").alias("was"), F.least("cluster", "low").alias("cluster")))
        labels = new.select("_doc", "cluster")
        if new.where("cluster <> was").isEmpty():
            break
    return keyed.select(F.col(key)).join(labels.withColumnRenamed("_doc", key), key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def first_of_class(clusters: DataFrame, key: str) -> DataFrame:
    """``key`` of the rows that stay when each class keeps its least key."""
    return clusters.where(F.col(key) == F.col("cluster")).select(key).distinct()
