"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import decontamination, divergence, exact_dedup, filter_audit, langid, licenses, lm_score, mixing, near_dup, packing, quality, substring, warc

QUERIES: dict[str, Callable] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_warc_revisit": warc.op2_warc_revisit,
    "op3_packing": packing.op3_packing,
    "op4_langid": langid.op4_langid,
    "op5_quality": quality.op5_quality,
    "op6_licenses": licenses.op6_licenses,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_substring": substring.op8_substring,
    "op9_near_dup": near_dup.op9_near_dup,
    "op10_mixing": mixing.op10_mixing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_warc_revisit": warc.OP2_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
