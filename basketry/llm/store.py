"""Shared storage for lineage cuts, and connected components by contraction."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import shared_root


BATCH_BYTES = 8 << 20
#: Rows of a column vector that Spark's Parquet reader fills; by default 4,096, however long their texts are.
VECTOR_ROWS = 512


def package_on_workers(spark: SparkSession) -> None:
    """Puts this package's folder on the Python path of the workers (a cluster without it there
    ships it by --py-files) and bounds the bytes of an Arrow batch, in tasks and in the JVM,
    and the rows of a column vector."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # freed buffers go back to the machine
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(VECTOR_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below spark.checkpoint.dir and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the smallest node reachable.

    Each round maps every node to the smallest of itself and its neighbours
    and contracts the graph, so the edges shrink quickly; the smallest node of
    a component maps to itself in every round.  Aggregates are minima (combined
    before the shuffle) and joins are on the node, which AQE can split, so a
    node with very many neighbours stays cheap.  Nodes can be of any ordered
    type.  Nothing is collected but whether edges are left.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = written(e, f"{name}-edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        m = written(m, f"{name}-map")
        maps.append(m)
        e = e.join(m.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        e = e.join(m.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        e = e.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        e = written(e, f"{name}-edges")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for m in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = m.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return out
