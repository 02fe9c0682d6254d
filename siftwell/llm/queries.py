"""The queries of the training-data operators, and SQL for those that SQL can express."""

from siftwell.llm import ann, bpe, html, jaccard, mixing, pii, quality, rans, rlz, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_pii": pii.op2_pii,
    "op3_rans": rans.op3_rans,
    "op4_urls": urls.op4_urls,
    "op5_quality": quality.op5_quality,
    "op6_bpe": bpe.op6_bpe,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_rlz": rlz.op8_rlz,
    "op9_html": html.op9_html,
    "op10_ann": ann.op10_ann,
}

ORACLE_SQL = {
    "op1_mixing": mixing.ORACLE,
    "op7_jaccard": jaccard.ORACLE,
    "op8_rlz": rlz.ORACLE,
}
