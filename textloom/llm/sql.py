"""Oracle SQL of the operators for training data, for DuckDB."""

_WHITE = r"'^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{B}\x{1C}-\x{1F}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{B}\x{1C}-\x{1F}]+$'"


def _term(c: str) -> str:
    return f"nullif(nfc_normalize(lower(regexp_replace({c}, {_WHITE}, '', 'g'))), '')"


_POSTINGS = f"""
p AS (SELECT term, doc_id, tf FROM (SELECT {_term("term")} AS term, doc_id, tf, loaded_at FROM postings)
      WHERE term IS NOT NULL AND doc_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY term, doc_id ORDER BY loaded_at DESC NULLS LAST, tf DESC NULLS LAST) = 1),
c AS (SELECT * FROM p WHERE tf >= 1)
"""

_P1 = f"""
WITH t AS (SELECT doc_id, position, max({_term("text")}) AS term FROM tokens
           WHERE doc_id IS NOT NULL AND position IS NOT NULL GROUP BY ALL),
{_POSTINGS},
o AS (SELECT 'token' AS origin, term, doc_id, count(*) AS n FROM t WHERE term IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'posting', term, doc_id, tf FROM c),
a AS (SELECT origin, count(DISTINCT doc_id) AS total FROM o GROUP BY origin),
f AS (SELECT origin, term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records FROM o GROUP BY ALL),
m AS (SELECT f.*, CASE WHEN records < 3 OR occurrences < 5 THEN 'rare' WHEN records > 0.3 * total THEN 'common' END AS mark
      FROM f JOIN a USING (origin))
"""

_P4 = f"""
WITH {_POSTINGS},
n AS (SELECT sum(num_docs) AS n FROM (SELECT num_docs FROM index_headers
      QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY built_at DESC NULLS LAST, num_docs DESC NULLS LAST) = 1)),
f AS (SELECT doc_id, doc_total_tokens FROM forward_entries
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, doc_total_tokens DESC NULLS LAST) = 1),
s AS (SELECT doc_id, sum(tf) AS s FROM c GROUP BY doc_id),
d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term),
w AS (SELECT c.doc_id, c.term, c.tf, d.cf, s.s, c.tf / CAST(CASE WHEN f.doc_total_tokens >= 1 THEN f.doc_total_tokens ELSE s.s END AS DOUBLE) * ln(n.n / CAST(d.df AS DOUBLE)) AS w
      FROM c JOIN s USING (doc_id) JOIN d USING (term) LEFT JOIN f USING (doc_id), n)
"""

SQL = {
    "p1_frequency": _P1 + "SELECT origin, term, occurrences, records, mark FROM m",
    "p1_found": _P1 + "SELECT origin, term, mark FROM m WHERE mark IS NOT NULL",
    "p4_found": _P4 + "SELECT doc_id, term FROM w WHERE w >= 0.12",
    "p4_ppmi": _P4
    + """, m AS (SELECT sum(pow(s, 0.75)) AS mass FROM s)
SELECT doc_id, term, round(greatest(ln(tf / (CAST(cf AS DOUBLE) * (pow(s, 0.75) / mass))), 0), 6) AS ppmi, round(w, 6) AS weight FROM w, m""",
}
