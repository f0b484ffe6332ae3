"""The opN queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, licenses, mixing, pii, sharding, simhash, tokenfile, tokens, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_sharding": sharding.op2_sharding,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_bpe": tokens.op4_bpe,
        "op5_pii": pii.op5_pii,
        "op6_tokenfile": tokenfile.op6_tokenfile,
        "op7_mixing": mixing.op7_mixing,
        "op8_topk": topk.op8_topk,
        "op9_ann": ann.op9_ann,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.oracle(), "op8_topk": topk.oracle()}
