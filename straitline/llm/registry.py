"""The queries of this subpackage, by name, and the SQL that returns the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from straitline.session import with_workers

from . import decontaminate, jaccard, langid, licenses, mixing, phrases, pii, quality, resampling, secrets, suffix_tree, topk, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_language_id": langid.op1,
        "op2_source_mixing": mixing.op2,
        "op3_exact_top_k": topk.op3,
        "op4_decontamination": decontaminate.op4,
        "op5_quality_score": quality.op5,
        "op6_license_scan": licenses.op6,
        "op7_personal_data": pii.op7,
        "op8_secret_scan": secrets.op8,
        "op9_jaccard_join": jaccard.op9,
        "op10_suffix_tree_score": suffix_tree.op10,
        "op11_warc_captures": warc.op11,
        "op12_phrase_collocations": phrases.op12,
        "op13_importance_resampling": resampling.op13,
    }
    return {name: with_workers(f) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": topk.ORACLE, "op9_jaccard_join": jaccard.ORACLE, "op11_warc_captures": warc.ORACLE, "op12_phrase_collocations": phrases.ORACLE, "op13_importance_resampling": resampling.ORACLE}
