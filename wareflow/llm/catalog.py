"""The queries of the training-data operators; ORACLE_SQL has those that SQL can express."""

from __future__ import annotations

from wareflow.llm import bpe, codes, decontam, fingerprint, html, langid, merkle, monoid, neardup, packing, pii, quality, warc

QUERIES = {
    "op1_personal_data": pii.query,
    "op2_quality": quality.query,
    "op3_main_text": html.query,
    "op4_fingerprint": fingerprint.query,
    "op5_decontamination": decontam.query,
    "op6_language": langid.query,
    "op7_bpe": bpe.query,
    "op8_warc": warc.query,
    "op9_packing": packing.query,
    "op10_near_duplicates": neardup.query,
    "op11_vector_codes": codes.query,
    "op12_manifest": merkle.query,
    "op13_tree_bpe": monoid.query,
}
#: A pair of documents that share no shingle links with nothing, so the join on shingles sees every link.
NEAR_DUPLICATES = r"""WITH RECURSIVE
  lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM lowered),
  each AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h, unnest(s) AS g FROM sets),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m
    FROM each a JOIN each b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n + m - shared)),
  edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id WHERE r.root < e.b),
  least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, root AS component_id, root = doc_id AS kept FROM sets JOIN least ON least.id = doc_id"""

ORACLE_SQL: dict[str, str] = {"op10_near_duplicates": NEAR_DUPLICATES, "op11_vector_codes": codes.ORACLE_SQL, "op12_manifest": merkle.ORACLE_SQL}
