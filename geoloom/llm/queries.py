"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, jaccard, langid, licenses, media, mixing, repeats, sharding, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_licenses": licenses.op2_licenses,
        "op3_bpe": bpe.op3_bpe,
        "op4_media": media.op4_media,
        "op5_warc": warc.op5_warc,
        "op6_repeats": repeats.op6_repeats,
        "op7_langid": langid.op7_langid,
        "op8_neighbours": ann.op8_neighbours,
        "op9_mixing": mixing.op9_mixing,
        "op10_jaccard": jaccard.op10_jaccard,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rows(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in pairs)


def licenses_sql(threshold: float = 0.8) -> str:
    """Words, places of the base phrases, and templates that a line holds ``threshold`` of, counted out without any filter."""
    words = lambda text: rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = _rows((k, v) for k, v in licenses.BASE.items())
    templates = _rows((k, v) for k, v in licenses.TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, text, {words("text")} AS w FROM documents),
p AS (SELECT string_split(phrase, ' ') AS q, label FROM (VALUES {phrases}) t(phrase, label)),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(q)] = q)) AS pos FROM d, p),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b FROM places GROUP BY 1),
t AS (SELECT label, list_distinct(string_split(template, ' ')) AS q FROM (VALUES {templates}) t(label, template)),
lines AS (SELECT DISTINCT doc_id, {words("line")} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
found AS (SELECT doc_id, label, max(len(list_intersect(q, w)) / len(q)) AS share FROM lines, t WHERE len(list_intersect(q, w)) >= {threshold} * len(q) - 1e-9 GROUP BY 1, 2),
every AS (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM places)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM places x WHERE x.doc_id = d.doc_id), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM every x WHERE x.doc_id = d.doc_id), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce((SELECT max(share) FROM found x WHERE x.doc_id = d.doc_id), 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id)"""


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
h AS (SELECT digest, min(page_id) AS head FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest, CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON h.digest = p.digest"""

JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": licenses_sql(), "op5_warc": WARC_SQL, "op10_jaccard": JACCARD_SQL}
