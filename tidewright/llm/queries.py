"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, exact_dedup, packing, pii, quality, shard, simhash, token_files, toxicity


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontaminate.op1,
        "op2_sharding": shard.op2,
        "op3_token_files": token_files.op3,
        "op4_chat_format": chat.op4,
        "op5_simhash_dedup": simhash.op5,
        "op6_toxicity": toxicity.op6,
        "op7_pii": pii.op7,
        "op8_packing": packing.op8,
        "op9_quality": quality.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat.OP4_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}
