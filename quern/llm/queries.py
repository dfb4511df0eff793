"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quern.llm import bpe, licenses, lines, manifest, minhash, mixing, pages, pii, quality, tokens, urls, vectors, whitening

QUERIES = (quality.op1_quality_rules, vectors.op2_cover_tree, mixing.op3_mixing, licenses.op4_license_scans, pii.op5_pii_surrogates, bpe.op6_byte_bpe, pages.op7_html, urls.op8_url_filters, minhash.op9_minhash, lines.op10_line_dedup,
           tokens.op11_token_files, whitening.op12_whitening, manifest.op13_merkle_manifest)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE_SQL, "op8_url_filters": urls.ORACLE_SQL, "op9_minhash": minhash.ORACLE_SQL, "op2_cover_tree": vectors.ORACLE_SQL, "op13_merkle_manifest": manifest.ORACLE_SQL}
