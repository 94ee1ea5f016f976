"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from gridloom.llm.ann import op7_ann
from gridloom.llm.chat import op10_chat
from gridloom.llm.linededup import op1_line_dedup
from gridloom.llm.media import op8_media
from gridloom.llm.mixing import op2_mixing
from gridloom.llm.neardup import op9_near_dup
from gridloom.llm.pieces import op6_pieces
from gridloom.llm.pii import op3_pii, pii_base_counts
from gridloom.llm.quality import op4_quality
from gridloom.llm.sharding import op5_sharding, sharding_sizes
from gridloom.llm.sql import ORACLES


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_pii, op4_quality, op5_sharding, op6_pieces, op7_ann, op8_media, op9_near_dup, op10_chat, pii_base_counts, sharding_sizes)}


def oracle_sql() -> dict:
    return dict(ORACLES)
