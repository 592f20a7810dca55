"""The SQL that must agree with the registered queries (DuckDB dialect)."""

from __future__ import annotations

from ..config import FALLBACK_BAD_WORDS, POLICY_PHRASES, STOP_WORDS
from . import planned_sql

_WS, _NWS = r"[ \t\n\r\f\x0B]", r"[^ \t\n\r\f\x0B]"


def _low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '{_NWS}+')"


def _candidates(t: str) -> str:
    blanks = "' ' || chr(9)"
    lines = f"list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '\\r$', ''), {blanks}))"
    short = f"list_filter({lines}, lambda x: x <> '' AND len(list_filter({_words('x')}, lambda w: strlen(w) > 1000)) = 0)"
    bare = f"list_transform({short}, lambda x: trim(regexp_replace(x, '\\[(?:citation needed|edit|[0-9]*)\\]', '', 'g'), {blanks}))"
    return f"list_filter({bare}, lambda x: x <> '' AND len({_words('x')}) >= 5 AND right(x, 1) IN ('.', '?', '!', '\"', '''') AND right(x, 3) <> '...')"


_POLICY = " OR ".join(f"contains({_low('x')}, '{p}')" for p in POLICY_PHRASES)
_KIND = f"CASE WHEN contains({_low('x')}, 'lorem ipsum') THEN 'lorem_ipsum' WHEN contains({_low('x')}, 'javascript') THEN 'skip' WHEN contains(x, '{{') THEN 'curly_bracket' WHEN {_POLICY} THEN 'skip' ELSE 'keep' END"


def c4(source: str) -> str:
    """CTEs up to ``c4(rid, id, given, c4_reason, c4_text)`` over ``source(rid, id, t)``."""
    return f"""
source AS ({source}),
cand AS (SELECT rid, id, t, {_candidates("t")} AS c FROM source),
kinds AS (SELECT *, list_transform(c, lambda x: {_KIND}) AS k FROM cand),
kept AS (SELECT rid, id, t, list_filter(k, lambda y: y IN ('lorem_ipsum', 'curly_bracket'))[1] AS event,
  list_filter(c, lambda x: ({_KIND}) = 'keep') AS good FROM kinds),
judged AS (SELECT rid, id, t, good, CASE WHEN t IS NULL THEN NULL ELSE coalesce(event, CASE WHEN len(good) < 5 THEN 'too_few_sentences' END, '') END AS c4_reason FROM kept),
c4 AS (SELECT rid, id, t AS given, c4_reason, CASE WHEN c4_reason = '' THEN array_to_string(good, chr(10)) ELSE t END AS c4_text FROM judged)"""


def paragraph(t: str) -> str:
    lines = f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE list_transform(string_split(regexp_replace({t}, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) END"
    sizes = f"list_reverse_sort(list_transform({lines}, lambda x: strlen(x)))"
    return f"CASE WHEN {t} IS NULL THEN NULL WHEN len({sizes}) < 3 THEN '< min_paragraphs' WHEN ({sizes})[3] < 200 THEN 'top 3 paragraphs too short' ELSE '' END"


def bad_words(t: str, words: tuple[str, ...] = FALLBACK_BAD_WORDS) -> str:
    tests = " ".join(f"WHEN regexp_matches({_low(t)}, '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN 'badword: {w}'" for w in words)
    return f"CASE WHEN {t} IS NULL THEN NULL {tests} ELSE '' END"


TEXTS = "SELECT row_number() OVER () AS rid, id, text AS t FROM texts"
TEXTS_FILLED = "SELECT row_number() OVER () AS rid, id, coalesce(text, '') AS t FROM texts"


def decided(source: str = TEXTS_FILLED) -> str:
    """CTEs up to ``decided(id, reason, final_text)``."""
    p = paragraph("c4_text")
    return f"""{c4(source)},
decided AS (SELECT rid, id, CASE WHEN given = '' THEN 'empty_text' WHEN c4_reason <> '' THEN c4_reason WHEN ({p}) <> '' THEN {p} ELSE {bad_words("c4_text")} END AS reason, c4_text AS final_text FROM c4)"""


_STATUS = "CASE WHEN reason = '' THEN 'kept' ELSE 'dropped' END"


def gopher_metrics(t: str) -> dict[str, str]:
    words = _words(t)
    real = f"list_filter({words}, lambda w: regexp_matches(w, '[^!-/:-@\\[-`{{-~]'))"
    lines = f"string_split({t}, chr(10))"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return {
        "n_words": f"len({words})",
        "n_real_words": f"len({real})",
        "real_bytes": f"coalesce(list_sum(list_transform({real}, lambda w: strlen(w)))::BIGINT, 0)",
        "alpha_words": f"len(list_filter({words}, lambda w: regexp_matches(w, '[A-Za-z]')))",
        "stop_words": f"len(list_filter({words}, lambda w: w IN ({stops})))",
        "hashes": f"len(regexp_extract_all({t}, '#'))",
        "ellipses": f"len(regexp_extract_all({t}, '\\.\\.\\.|…'))",
        "n_lines": f"len({lines})",
        "bullet_lines": f"len(list_filter({lines}, lambda x: regexp_matches(x, '^{_WS}*[-•]')))",
        "ellipsis_lines": f"len(list_filter({lines}, lambda x: regexp_matches(x, '(?:\\.\\.\\.|…){_WS}*$')))",
    }


def gopher(source: str) -> str:
    """CTEs up to ``gopher(key, t, <metrics>, gopher_reason)`` over ``source(key, t)``."""
    cols = ", ".join(f"CASE WHEN t IS NOT NULL THEN {v} END::BIGINT AS {k}" for k, v in gopher_metrics("t").items())
    return f"""
docs AS ({source}),
measured AS (SELECT key, t, {cols} FROM docs),
gopher AS (SELECT *, CASE WHEN n_words IS NULL THEN NULL
  WHEN n_words = 0 OR n_real_words < 50 THEN 'gopher_short_doc'
  WHEN n_real_words > 100000 THEN 'gopher_long_doc'
  WHEN real_bytes::DOUBLE / n_real_words < 3 THEN 'gopher_below_avg_threshold'
  WHEN real_bytes::DOUBLE / n_real_words > 10 THEN 'gopher_above_avg_threshold'
  WHEN hashes::DOUBLE / n_words > 0.1::DOUBLE THEN 'gopher_too_many_hashes'
  WHEN ellipses::DOUBLE / n_words > 0.1::DOUBLE THEN 'gopher_too_many_ellipsis'
  WHEN bullet_lines::DOUBLE / n_lines > 0.9::DOUBLE THEN 'gopher_too_many_bullets'
  WHEN ellipsis_lines::DOUBLE / n_lines > 0.3::DOUBLE THEN 'gopher_too_many_end_ellipsis'
  WHEN alpha_words::DOUBLE / n_words < 0.8::DOUBLE THEN 'gopher_below_alpha_threshold'
  WHEN stop_words < 2 THEN 'gopher_enough_stop_words' ELSE '' END AS gopher_reason FROM measured)"""


_BLOB = "coalesce(content, ''::BLOB)::VARCHAR"
_PLAIN = r"regexp_replace({}, '\\x[0-9A-F][0-9A-F]', '.', 'g')"
_PAGE = "TRY(decode(coalesce(content, ''::BLOB)))"
_BODY = "CASE WHEN contains({0}, chr(13) || chr(10) || chr(13) || chr(10)) THEN substr({0}, position(chr(13) || chr(10) || chr(13) || chr(10) IN {0}) + 4) WHEN contains({0}, chr(10) || chr(10)) THEN substr({0}, position(chr(10) || chr(10) IN {0}) + 2) ELSE {0} END"


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    escaped = f"SELECT path, ordinal, {_BLOB} AS b FROM warc_records WHERE type = 'response'"
    out["extract_http_body"] = rf"""WITH e AS ({escaped}), p AS (SELECT path, ordinal, b,
  CASE WHEN contains(b, '\x0D\x0A\x0D\x0A') THEN substr(b, position('\x0D\x0A\x0D\x0A' IN b) + 16) WHEN contains(b, '\x0A\x0A') THEN substr(b, position('\x0A\x0A' IN b) + 8) ELSE b END AS rest FROM e)
SELECT path, ordinal, (length({_PLAIN.format("b")}) - length({_PLAIN.format("rest")}))::INTEGER AS body_start, length({_PLAIN.format("rest")})::INTEGER AS body_size FROM p"""
    out["extract_text"] = rf"""WITH d AS (SELECT path, ordinal, id, {_PAGE} AS p FROM warc_records WHERE type = 'response'),
b AS (SELECT path, ordinal, id, {_BODY.format("p")} AS h FROM d)
SELECT path, ordinal, id, regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '<[^>]*$', '') AS text FROM b"""
    out["warc_fields"] = """SELECT path, ordinal, map_extract(headers, 'WARC-Type')[1] AS h_type, map_extract(headers, 'WARC-Record-ID')[1] AS h_id,
map_extract(headers, 'WARC-Target-URI')[1] AS h_url, map_extract(headers, 'WARC-Date')[1] AS h_date, cardinality(headers)::INTEGER AS n_headers, coalesce(octet_length(content), 0)::INTEGER AS content_size,
coalesce(octet_length(content), 0) < content_length AS truncated FROM warc_records"""
    out["record_types"] = "SELECT type, count(*) AS n, sum(content_length)::BIGINT AS bytes FROM warc_records GROUP BY type"
    out["c4_line_candidates"] = f"WITH s AS (SELECT id, unnest({_candidates('text')}) AS line FROM texts) SELECT id, line FROM s"
    out["c4_quality"] = f"WITH {c4(TEXTS)} SELECT id, c4_reason, c4_text FROM c4"
    out["c4_paragraph"] = f"SELECT id, {paragraph('text')} AS reason FROM texts"
    out["bad_words_fallback"] = f"SELECT id, {bad_words('text')} AS reason FROM texts"
    listed = rf"""WITH w AS (SELECT min(entry_no) AS no, rtrim(entry, ' ' || chr(9) || chr(10) || chr(13)) AS e FROM badwords GROUP BY 2),
u AS (SELECT * FROM w WHERE e <> '' AND NOT regexp_matches(e, '[A-Z]')),
s AS (SELECT row_number() OVER () AS rid, id, text, {_low("text")} AS low FROM texts),
h AS (SELECT rid, arg_min(e, no) AS first FROM s, u WHERE contains(low, e) AND regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(e) || '([^a-z0-9]|$)') GROUP BY rid)
SELECT s.id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce('badword: ' || h.first, '') END AS reason FROM s LEFT JOIN h USING (rid)"""
    out["bad_words_listed"] = listed
    keyed = listed.replace("row_number() OVER () AS rid, id, text", "doc_id AS rid, doc_id AS id, text").replace("FROM texts", "FROM documents").replace("SELECT s.id,", "SELECT s.id AS doc_id,")
    out["bad_words_joined"] = keyed
    out["gopher_metrics"] = f"WITH {gopher('SELECT doc_id AS key, text AS t FROM documents')} SELECT key AS doc_id, {', '.join(gopher_metrics('t'))} FROM gopher"
    out["gopher_quality"] = f"WITH {gopher('SELECT id AS key, text AS t FROM texts')} SELECT key AS id, gopher_reason FROM gopher"
    out["gopher_verdicts"] = f"WITH {gopher('SELECT doc_id AS key, text AS t FROM documents')} SELECT key AS doc_id, CASE WHEN gopher_reason = '' THEN 'keep' ELSE 'drop' END || chr(9) || gopher_reason AS verdict FROM gopher"
    nonempty = "SELECT id AS key, text AS t FROM texts WHERE text <> ''"
    out["gopher_summary"] = f"WITH {gopher(nonempty)} SELECT count(*) AS docs, count(*) FILTER (gopher_reason = '') AS kept, coalesce(sum(strlen(t)), 0)::BIGINT AS bytes FROM gopher"
    out["pipeline_decisions"] = f"WITH {decided()} SELECT id AS record_id, {_STATUS} AS status, reason FROM decided"
    docs = "SELECT doc_id AS rid, doc_id AS id, coalesce(text, '') AS t FROM documents"
    out["document_decisions"] = f"WITH {decided(docs)} SELECT id AS record_id, {_STATUS} AS status, reason FROM decided"
    out["pipeline_totals"] = f"WITH {decided()} SELECT count(*) AS docs, count(*) FILTER (reason = '') AS kept, count(*) FILTER (reason <> '') AS dropped, coalesce(sum(strlen(final_text)), 0)::BIGINT AS bytes FROM decided"
    out["drop_reasons"] = f"WITH {decided()} SELECT reason, count(*) AS n FROM decided WHERE reason <> '' GROUP BY reason"
    out["excluded_rows"] = f"""WITH {decided()} SELECT id AS record_id, CASE WHEN reason = 'empty_text' THEN 'empty' WHEN reason IN ('lorem_ipsum', 'curly_bracket', 'too_few_sentences') THEN 'quality' WHEN starts_with(reason, 'badword: ') THEN 'bad_words' ELSE 'paragraph' END AS stage, reason FROM decided WHERE reason <> ''"""
    first = f"SELECT row_number() OVER () AS rid, id, {_PAGE} AS p FROM (SELECT * FROM warc_records WHERE type = 'response' ORDER BY path, ordinal LIMIT 500)"
    source = rf"SELECT rid, id, coalesce(regexp_replace(regexp_replace({_BODY.format('p')}, '<[^>]*>', ' ', 'g'), '<[^>]*$', ''), '') AS t FROM ({first})"
    out["first_500_decisions"] = f"WITH {decided(source)} SELECT id AS record_id, {_STATUS} AS status, reason FROM decided"
    out["decision_csv"] = """SELECT record_id || ',' || coalesce(status, '') || ',' || CASE WHEN regexp_matches(coalesce(reason, ''), '[",\\r\\n]') THEN '"' || replace(reason, '"', '""') || '"' ELSE coalesce(reason, '') END AS line FROM decisions"""
    out["jsonl_roundtrip"] = "SELECT id, text FROM texts"
    best = "SELECT record_id, max(row(coalesce(status, ''), coalesce(reason, ''))) AS b FROM {} WHERE record_id IS NOT NULL AND record_id <> '' GROUP BY record_id"
    out["regression_diff"] = f"""WITH {decided()}, now AS (SELECT id AS record_id, {_STATUS} AS status, reason FROM decided),
b AS (SELECT record_id, b[1] AS bs, b[2] AS br FROM ({best.format("decisions")})), c AS (SELECT record_id, b[1] AS cs, b[2] AS cr FROM ({best.format("now")})),
j AS (SELECT coalesce(b.record_id, c.record_id) AS id, bs, br, cs, cr, CASE WHEN bs IS NULL THEN 'extra_in_current' WHEN cs IS NULL THEN 'missing_in_current' WHEN bs <> cs THEN 'status_mismatch' WHEN br <> cr THEN 'reason_mismatch' END AS type FROM b FULL OUTER JOIN c ON b.record_id = c.record_id)
SELECT id, type, CASE type WHEN 'status_mismatch' THEN bs WHEN 'reason_mismatch' THEN br END AS base, CASE type WHEN 'status_mismatch' THEN cs WHEN 'reason_mismatch' THEN cr END AS curr,
CASE type WHEN 'status_mismatch' THEN br END AS reason_base, CASE type WHEN 'status_mismatch' THEN cr END AS reason_curr FROM j WHERE type IS NOT NULL"""
    out["regression_tally"] = out["regression_diff"].rsplit("\nSELECT id, type,", 1)[0] + "\nSELECT type, count(*) AS n FROM j WHERE type IS NOT NULL GROUP BY type"
    out["text_primitives"] = rf"""SELECT doc_id, len(CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END)::INTEGER AS n_lines,
len({_words("text")})::INTEGER AS n_words, strlen(regexp_replace(text, '\[(?:citation needed|edit|[0-9]*)\]', '', 'g'))::INTEGER AS uncited_bytes,
strlen({_low("text")})::INTEGER AS low_bytes, md5({_low("text")}) AS low_md5, len(list_filter({_words("text")}, lambda w: strlen(w) > 20)) > 0 AS long_word FROM documents WHERE text IS NOT NULL"""
    out["stage_profile"] = "SELECT event_type AS stage, round(sum(value), 4) AS total_ms, count(*) AS calls, round(avg(value), 4) AS avg_ms FROM events GROUP BY event_type"
    out["kept_rows"] = f"WITH {decided()} SELECT id AS record_id, final_text AS text FROM decided WHERE reason = ''"
    out["outcome_tally"] = f"WITH {decided()} SELECT reason, count(*) AS n, coalesce(sum(strlen(final_text)), 0)::BIGINT AS bytes FROM decided GROUP BY reason"
    return out | planned_sql.files(out["regression_diff"]) | planned_sql.planned()
