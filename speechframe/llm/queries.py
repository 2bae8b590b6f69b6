"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, near_dedup, packing, passages, quality, sharding, suffix_dedup, token_counts

QUERIES = {
    f.__name__: f
    for f in (
        decontamination.op1_decontamination,
        near_dedup.op2_minhash_near_dedup,
        exact_dedup.op3_exact_dedup,
        suffix_dedup.op4_suffix_array_dedup,
        quality.op5_quality_classifier,
        token_counts.op6_token_counts,
        passages.op7_substring_dedup,
        packing.op8_best_fit_packing,
        chat_format.op9_chat_formatting,
        sharding.op10_sharding,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op3_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY t)""",
    "op9_chat_formatting": chat_format.OP9_SQL,
}
