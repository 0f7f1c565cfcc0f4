"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quire.llm import bpe, katz, licenses, line_quality, multiset, packing, pii, simhash, toxicity, warc

QUERIES = {
    "op9_katz": katz.query,
    "op2_toxicity": toxicity.query,
    "op6_pii": pii.query,
    "op4_warc": warc.query,
    "op1_simhash": simhash.query,
    "op3_fingerprints": multiset.query,
    "op8_licenses": licenses.query,
    "op5_packing": packing.query,
    "op7_bpe": bpe.query,
    "op10_line_quality": line_quality.query,
}

ORACLES = {
    "op4_warc": warc.ORACLE,
    "op10_line_quality": line_quality.ORACLE,
}
