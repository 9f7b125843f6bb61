"""Chunked load: the first chunk replaces the table, later chunks append, and readers see all or nothing.

The source copies a table in fixed-size chunks, truncating on the first
chunk and appending the rest, so a failure halfway leaves a partial table.
Here the chunks are the files of a landing folder, taken with Structured
Streaming (``availableNow`` trigger, ``maxFilesPerTrigger`` files per
micro-batch; the stream carries file names only).  ``foreachBatch`` writes each
micro-batch into a data folder of its own and notes it in a ledger,
``_ledger/<load>/<batch>.json``; a batch replayed after a failure replaces its own
folder and entry, so no row is there twice.

When all batches are in, one manifest publishes every folder of the ledger
(``sources.published``).  Until then readers keep the table as it was: a run
stopped halfway shows nothing of itself, and a restart goes on after the last
committed batch and then publishes all of them together.  The load is known by its checkpoint: a new
checkpoint starts a new load, whose first publication replaces the table.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from basketry.sources import files, published
from basketry.sources.loaders import read_csv

LEDGER = "_ledger"
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _load_id(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _folder(load: str, batch_id: int) -> str:
    return f"data-{load}-{batch_id:09d}"


def _writer(spark: SparkSession, schema: StructType, target: str, load: str, fmt: str, multi_line: bool):
    def write(batch: DataFrame, batch_id: int) -> None:
        names = [r.path for r in batch.select("path").collect()]  # at most files_per_chunk
        rows = read_csv(spark, names, schema, multi_line) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(names)
        folder = _folder(load, batch_id)
        rows.write.mode("overwrite").parquet(f"{target}/{folder}")
        files.write_text(spark, f"{target}/{LEDGER}/{load}/{batch_id:09d}.json", json.dumps({"folder": folder, "files": names}), overwrite=True)

    return write


def ledger(spark: SparkSession, target: str, checkpoint: str) -> list[str]:
    """Data folders of the batches that this load has finished, in order."""
    at = f"{target}/{LEDGER}/{_load_id(checkpoint)}"
    return [json.loads(files.read_text(spark, f"{at}/{name}"))["folder"] for name, n, _ in sorted(files.children(spark, at)) if name.endswith(".json") and n]


def load_in_chunks(spark: SparkSession, landing: str, schema: StructType, target: str, checkpoint: str,
                   files_per_chunk: int = 1, fmt: str = "csv", multi_line: bool = False) -> int:
    """Run the chunked load to completion and publish it; returns the number of micro-batches this run added."""
    before = len(ledger(spark, target, checkpoint))
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_chunk).option("recursiveFileLookup", True).load(landing).select("path")
    q = (stream.writeStream.foreachBatch(_writer(spark, schema, target, _load_id(checkpoint), fmt, multi_line))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    folders = ledger(spark, target, checkpoint)
    now = published.current(spark, target)
    if now is None or list(now.folders) != folders:
        published.publish(spark, target, folders, schema, info={"load": _load_id(checkpoint)})
    return len(folders) - before


def read_loaded(spark: SparkSession, target: str) -> DataFrame:
    return published.read(spark, target)
