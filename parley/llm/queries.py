"""The queries of the training-data problems: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from . import collapse, conversations, crosssplit, defects, matching, mixing, neardup, packing, repetition, truncation


def queries() -> dict:
    return {
        "p1_found": conversations.found,
        "p2_found": defects.found,
        "p2_labels": defects.labels,
        "p3_found": crosssplit.found,
        "p3_report": crosssplit.report,
        "p4_found": collapse.found,
        "p4_groups": collapse.distinct_records,
        "p5_found": neardup.found,
        "p5_classes": neardup.classes,
        "p6_found": truncation.found,
        "p6_rates": truncation.rates,
        "p7_found": matching.found,
        "p7_matches": matching.all_matches,
        "p8_packing": packing.packing,
        "p8_unused": packing.unused,
        "p9_uses": mixing.uses,
        "p9_shares": mixing.shares,
        "p10_found": repetition.found,
        "p10_repetition": repetition.repetition,
        "p10_fertility": repetition.bands,
    }


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.ORACLE
