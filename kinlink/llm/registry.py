"""The queries of this subpackage and their SQL, by name."""

from . import decontam, html_extract, katz, langid, minhash, mixing, quality, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_html": html_extract.op2_html,
    "op3_topk": topk.op3_topk,
    "op4_quality": quality.op4_quality,
    "op5_decontam": decontam.op5_decontam,
    "op6_langid": langid.op6_langid,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mixing": mixing.op8_mixing,
    "op9_katz": katz.op9_katz,
    "op10_suffix": suffix_dedup.op10_suffix,
}

ORACLES = {
    "op3_topk": topk.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
}
