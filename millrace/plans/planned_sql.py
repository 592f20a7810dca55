"""The SQL of the planned steps and of what passes through files (DuckDB dialect)."""

from __future__ import annotations

from ..operators.extensions import HOST, IPV4, KANA_SHARE, LANGUAGE_WORDS, MAIL, REPETITION, REPETITION_LIMITS

_WORDS = r"regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')"


def files(difference: str) -> dict[str, str]:
    filled = "nullif({0}, '') AS {0}"
    return {
        "warc_read": "SELECT replace(path, '/', '_') AS file, ordinal, coalesce(id, '') AS id, coalesce(url, '') AS url, type, coalesce(octet_length(content), 0)::BIGINT AS content_length, md5(coalesce(content, ''::BLOB)) AS digest FROM warc_records",
        "jsonl_file": "SELECT id, text FROM texts",
        "decisions_file": "SELECT record_id, coalesce(status, '') AS status, coalesce(reason, '') AS reason FROM decisions WHERE record_id <> ''",
        "differences_file": f"SELECT {', '.join(filled.format(c) for c in ('id', 'type', 'base', 'curr', 'reason_base', 'reason_curr'))} FROM ({difference})",
    }


def planned() -> dict[str, str]:
    """The planned steps. Arrays of lines and words as the expressions have them."""
    host = f"lower(nullif(regexp_extract(url, '{HOST}', 1), ''))"
    out = {
        "url_filtered": f"SELECT path, ordinal, url FROM warc_records WHERE type = 'response' AND ({host} IS NULL OR {host} NOT IN (SELECT lower(source) FROM documents WHERE starts_with(source, 'blog.')))",
        "personal_formatted": rf"SELECT id, regexp_replace(regexp_replace(text, '{MAIL}', 'email@example.com', 'g'), '{IPV4}', '192.0.2.1', 'g') AS text FROM texts",
    }
    scores = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own)})))" for own in LANGUAGE_WORDS.values())
    names = ", ".join(f"'{x}'" for x in LANGUAGE_WORDS)
    out["document_languages"] = f"""WITH a AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w, len(regexp_extract_all(text, '[ぁ-ゟ゠-ヿ]')) AS kana FROM documents),
b AS (SELECT *, [{scores}] AS s FROM a)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN text <> '' AND kana > {KANA_SHARE}::DOUBLE * length(text) THEN 'ja' WHEN list_max(s) = 0 THEN '' ELSE [{names}][list_position(s, list_max(s))] END AS language FROM b"""
    parts = "list_filter(list_transform({}, lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"
    lines, paragraphs = parts.format("string_split(text, chr(10))"), parts.format("string_split_regex(text, '\n\n+')")
    chars = "length(array_to_string({}, ''))"
    grams = "\n".join(
        f""", g{n} AS (SELECT doc_id, count(*) AS c, length(g) AS size FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM a WHERE len(w) >= {n}) GROUP BY doc_id, g HAVING count(*) > 1),
t{n} AS (SELECT doc_id, max(row(c, size)) AS m FROM g{n} GROUP BY doc_id)"""
        for n in (2, 3, 4)
    )
    tops = ", ".join(f"CASE WHEN text IS NOT NULL THEN coalesce(t{n}.m[1] * t{n}.m[2], 0) END::BIGINT AS top_{n}_chars" for n in (2, 3, 4))
    joins = " ".join(f"LEFT JOIN t{n} USING (doc_id)" for n in (2, 3, 4))
    reason = " ".join(f"WHEN {p}::DOUBLE / nullif({w}, 0) > {most}::DOUBLE THEN '{p}'" for p, w, most in REPETITION_LIMITS)
    out["repetition_counts"] = f"""WITH a AS (SELECT doc_id, text, {lines} AS l, {paragraphs} AS p, {_WORDS} AS w FROM documents) {grams},
r AS (SELECT doc_id, len(l)::BIGINT AS lines, (len(l) - len(list_distinct(l)))::BIGINT AS duplicate_lines, {chars.format("l")}::BIGINT AS line_chars,
({chars.format("l")} - {chars.format("list_distinct(l)")})::BIGINT AS duplicate_line_chars, len(p)::BIGINT AS paragraphs, (len(p) - len(list_distinct(p)))::BIGINT AS duplicate_paragraphs, length(text)::BIGINT AS chars, {tops} FROM a {joins})
SELECT doc_id, {", ".join(REPETITION)}, CASE WHEN chars IS NULL THEN NULL {reason} ELSE '' END AS reason FROM r"""
    out["web_text"] = f"""WITH a AS (SELECT doc_id, text, {lines} AS l FROM documents), b AS (SELECT *, len(l)::DOUBLE AS n, {chars.format("l")}::DOUBLE AS c, {chars.format("list_distinct(l)")}::DOUBLE AS u FROM a)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN n = 0 THEN 'no_lines' WHEN len(list_filter(l, lambda x: right(x, 1) IN ('.', '!', '?', '"', ''''))) / n < 0.12::DOUBLE THEN 'line_punctuation'
WHEN len(list_filter(l, lambda x: length(x) < 30)) / n > 0.67::DOUBLE THEN 'short_lines' WHEN (c - u) / nullif(c, 0) > 0.01::DOUBLE THEN 'repeated_lines'
WHEN len(regexp_extract_all(text, '\n'))::DOUBLE / nullif(len({_WORDS}), 0) > 0.3::DOUBLE THEN 'line_breaks' ELSE '' END AS reason FROM b"""
    return out
