"""HTTP body and tag stripping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_text(content: Column) -> Column:
    """Bytes as text; ill-formed UTF-8 becomes U+FFFD instead of an error."""
    return F.make_valid_utf8(content.cast("string"))


def http_body(response: Column) -> Column:
    """What follows the first blank line: CRLF CRLF if there is one anywhere, else LF LF, else all."""
    crlf, lf = F.locate("\r\n\r\n", response), F.locate("\n\n", response)
    return F.when(crlf > 0, F.substring(response, crlf + 4, F.length(response))).when(lf > 0, F.substring(response, lf + 2, F.length(response))).otherwise(response)


def strip_tags(html: Column) -> Column:
    """Each ``<...>`` becomes one blank; an unclosed ``<`` cuts the rest."""
    return F.when(F.contains(html, F.lit("<")), F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"<[^>]*\z", "")).otherwise(html)


def body_bytes(content: Column) -> Column:
    """``STRUCT<start, size>`` in bytes of the HTTP body within the payload, whatever its charset."""
    # One character a byte, so positions are byte positions.
    raw = F.decode(F.coalesce(content, F.lit(b"")), "ISO-8859-1")
    body = F.length(http_body(raw))
    return F.struct((F.length(raw) - body).alias("start"), body.alias("size"))


def extract_texts(records: DataFrame, ill_formed: str = "replace") -> DataFrame:
    """``path, ordinal, id, text`` of the responses. Null content counts as empty. Row-local.

    ``ill_formed``: payloads that are no UTF-8 get U+FFFD for what is wrong
    (``replace``) or a null text (``null``).
    """
    raw = F.coalesce(F.col("content").cast("string"), F.lit(""))
    text = strip_tags(http_body(F.try_validate_utf8(raw) if ill_formed == "null" else F.make_valid_utf8(raw)))
    return records.where(F.col("type") == "response").select("path", "ordinal", "id", text.alias("text"))


def first_responses(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` responses in file order; all for -1, none for 0 or any other negative."""
    only = records.where(F.col("type") == "response")
    if n == -1:
        return only
    return only.orderBy("path", "ordinal").limit(max(0, n))
