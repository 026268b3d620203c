"""Queries of this subpackage and the SQL for the same rows, where SQL can express them."""

from __future__ import annotations

from . import langid, licenses, minhash, mixing, packing, pieces, quality, tokenfile, vectors, warc

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_language_id": langid.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_token_ids": tokenfile.op6_token_ids,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_embedding_near_dups": vectors.op8_embedding_near_dups,
    "op9_lm_scores": mixing.op9_lm_scores,
    "op10_warc": warc.op10_warc,
    "embedding_recall": vectors.embedding_recall,
}

#: Five hex digits are four base-32 digits.
_BASE32 = " || ".join(f"lpad(to_base(('0x' || substr(h, {5 * i + 1}, 5))::BIGINT, 32), 4, '0')" for i in range(8))

ORACLES = {
    "op8_embedding_near_dups": vectors.ORACLE,
    "op1_near_duplicates": minhash.ORACLE,
    "op3_license_scan": licenses.oracle(),
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM k""",
}
