"""The registered queries of the operators: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import bpe, chat, decontaminate, embeddings, fim, jaccard, licenses, lines, merkle, quality, repeats, sharding, toxicity
from basketry.llm.store import package_on_workers

Query = Callable[[SparkSession, str], DataFrame]


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        package_on_workers(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, tuple[Query, str | None]] = {
    name: (_registered(query), sql)
    for name, (query, sql) in {
        "op1_bradley_terry": (quality.digest, None),
        "op2_line_dedup": (lines.digest, lines.SQL),
        "op3_bpe": (bpe.digest, None),
        "op4_hash_ring": (sharding.digest, None),
        "op5_suffix_array": (repeats.digest, None),
        "op6_jaccard_trie": (jaccard.digest, jaccard.SQL),
        "op7_licenses": (licenses.digest, None),
        "op8_toxicity": (toxicity.digest, None),
        "op9_decontaminate": (decontaminate.digest, decontaminate.SQL),
        "op10_epsilon_grid": (embeddings.digest, embeddings.SQL),
        "op11_fill_in_middle": (fim.digest, fim.SQL),
        "op12_chat_format": (chat.digest, chat.SQL),
        "op13_merkle_manifest": (merkle.digest, merkle.SQL),
    }.items()
}
