"""The corpus queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import blocks, decontaminate, divergence, host_rules, manifest, minhash, packing, quality, sharding, simhash, suffixes, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (quality.op1_quality, blocks.op2_blocks, decontaminate.op3_winnowing, packing.op4_packing, host_rules.op5_host_rules, simhash.op6_simhash, suffixes.op7_suffixes, warc.op8_merkle_audit, sharding.op9_bounded_ring, toxicity.op10_toxicity, divergence.op11_divergence, minhash.op12_minhash, manifest.op13_manifest)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_blocks": blocks.ORACLE, "op3_winnowing": decontaminate.ORACLE, "op5_host_rules": host_rules.ORACLE, "op8_merkle_audit": warc.ORACLE, "op11_divergence": divergence.ORACLE, "op12_minhash": minhash.ORACLE, "op13_manifest": manifest.ORACLE}
