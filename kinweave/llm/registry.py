"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_toxicity, op2_packing, op3_maxscore, op4_licenses, op5_quality, op6_html, op7_chat, op8_bpe, op9_sstable, op10_simhash, op11_decontaminate, op12_filter_audit, op13_clusters


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity.query,
        "op2_packing": op2_packing.query,
        "op3_maxscore": op3_maxscore.query,
        "op4_licenses": op4_licenses.query,
        "op5_quality": op5_quality.query,
        "op6_html": op6_html.query,
        "op7_chat": op7_chat.query,
        "op8_bpe": op8_bpe.query,
        "op9_sstable": op9_sstable.query,
        "op10_simhash": op10_simhash.query,
        "op11_decontaminate": op11_decontaminate.query,
        "op12_filter_audit": op12_filter_audit.query,
        "op13_clusters": op13_clusters.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_maxscore": op3_maxscore.ORACLE,
        "op4_licenses": op4_licenses.ORACLE,
        "op7_chat": op7_chat.ORACLE,
        "op11_decontaminate": op11_decontaminate.ORACLE,
        "op12_filter_audit": op12_filter_audit.ORACLE,
        "op13_clusters": op13_clusters.ORACLE,
    }
