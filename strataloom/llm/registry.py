"""Queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from strataloom.llm import ann, decontaminate, langid, mixing, records, secrets, sharding, simhash, suffixes, toxicity

QUERIES = {
    "op1_ann": ann.op1,
    "op2_records": records.op2,
    "op3_toxicity": toxicity.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_mixing": mixing.op5,
    "op6_suffixes": suffixes.op6,
    "op7_simhash": simhash.op7,
    "op8_secrets": secrets.op8,
    "op9_language_id": langid.op9,
    "op10_sharding": sharding.op10,
}
ORACLES: dict[str, str] = {"op5_mixing": mixing.ORACLE}
