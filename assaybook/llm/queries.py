"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assaybook.llm import jaccard_join, mixing, mpeg_audio, pieces, pii, suffix_dedup, token_frames, topk, toxicity, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_token_frames": token_frames.op2_token_frames,
        "op3_warc": warc.op3_warc,
        "op4_mixing": mixing.op4_mixing,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_jaccard_join": jaccard_join.op7_jaccard_join,
        "op8_media": mpeg_audio.op8_media,
        "op9_pieces": pieces.op9_pieces,
        "op10_topk": topk.op10_topk,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.OP4_SQL, "op10_topk": topk.OP10_SQL}
