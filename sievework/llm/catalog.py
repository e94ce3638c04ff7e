"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses, lm, mixing, neardup, pii, secrets, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": licenses.op1_licenses,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_secrets": secrets.op4_secrets,
    "op5_minhash": neardup.op5_minhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_lm": lm.op7_lm,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES = {
    "op1_licenses": licenses.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op4_secrets": secrets.ORACLE,
    "op5_minhash": neardup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
