"""The operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from portlens.llm import checks, op01_mixing, op02_toxicity, op03_quality, op04_packing, op05_lm_score, op06_materialise, op07_fingerprint, op08_jaccard, op09_chat, op10_lines, op11_decontaminate, op12_alignment, op13_collocations
from portlens.llm.common import table


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": _over("documents", op01_mixing.query),
        "op2_toxicity": lambda spark, sf_dir: op02_toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op3_quality": _over("documents", op03_quality.query),
        "op4_packing": _over("documents", op04_packing.query),
        "op5_lm_score": _over("documents", op05_lm_score.query),
        "op6_materialise": _over("documents", op06_materialise.query),
        "op7_fingerprint": _over("documents", op07_fingerprint.query),
        "op8_jaccard_join": _over("documents", op08_jaccard.query),
        "op9_chat": _over("conversations", op09_chat.query),
        "op10_line_dedup": _over("documents", op10_lines.query),
        "op11_decontaminate": lambda spark, sf_dir: op11_decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op12_alignment": _over("documents", op12_alignment.query),
        "op13_collocations": _over("documents", op13_collocations.query),
        "pipeline": pipeline,
    }


def check_sql() -> dict[str, str]:
    return dict(checks.SQL)
