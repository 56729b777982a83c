"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, media, mixing, packing, sharding, simhash, tokenfile, topk, toxicity, urlfilter
from .common import read_table


def _on(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(*(read_table(spark, sf_dir, t) for t in tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_audio": _on(media.documents_as_media, "documents"),
    "op2_noisy_or_toxicity": _on(toxicity.toxicity, "documents", "labels"),
    "op3_simhash_byte_index": _on(simhash.near_duplicate_groups, "documents"),
    "op4_snapshot_collapse": _on(chat.maximal_conversations, "conversations"),
    "op5_two_pass_shuffle": _on(sharding.shard_documents, "documents"),
    "op6_url_rules": _on(urlfilter.url_verdicts, "pages"),
    "op7_differencing_packing": _on(packing.packed_documents, "documents"),
    "op8_uniform_threshold_topk": _on(topk.nearest, "embeddings"),
    "op9_arrow_token_files": _on(tokenfile.token_ids, "documents"),
    "op10_splitting_tree_mix": _on(mixing.mixed_sizes, "documents"),
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_snapshot_collapse": chat.ORACLE,
    "op6_url_rules": urlfilter.ORACLE,
    "op8_uniform_threshold_topk": topk.ORACLE,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
