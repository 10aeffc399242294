"""The queries of this subpackage, one per operator, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import decontamination, hamming_search, html_extract, langid, mixing, resampling, sharding, simhash, spelling, substring_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_hamming_search": hamming_search.op2_hamming_search,
    "op3_simhash": simhash.op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_language_id": langid.op6_language_id,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_sharding": sharding.op8_sharding,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_resampling": resampling.op11_resampling,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_spelling": spelling.op13_spelling,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_hamming_search": hamming_search.OP2_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op9_decontamination": decontamination.OP9_SQL,
    "op10_suffix_dedup": suffix_dedup.OP10_SQL,
    "op11_resampling": resampling.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
