"""The text operators' queries, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, chat, exact_dedup, jaccard, langid, lines, mixing, pii, quality


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_bpe": bpe.op2_bpe,
        "op3_pii": pii.op3_pii,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_jaccard_join": jaccard.op5_jaccard_join,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_langid": langid.op7_langid,
        "op8_ann": ann.op8_ann,
        "op9_preferences": chat.op9_preferences,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict:
    return {
        "op4_line_dedup": lines.OP4_SQL,
        "op6_source_mixing": mixing.OP6_SQL,
        "op9_preferences": chat.OP9_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
    }
