"""CSV records with quoted line breaks from files that many tasks read.

Spark reads a CSV file with quoted line breaks in one task, as a split may
start inside a quoted field.  Here the file is read as lines, which split
anywhere, and the quoting state at the start of every split comes from a
prefix scan:

1. Every split runs a two-state machine (outside, inside a quoted field) over its lines from both
   states at once, and yields the state it ends in for each, the lines up to the first
   record start and the open record at its end: one row for each split.
2. The end states are composed in file order, so the state in which each split really starts is known.  This
   takes one pair of flags for each split to the driver, as many as the tasks it schedules.
3. A second scan starts every split in its state and yields the records that
   lie whole in the split; the pieces of records across splits, two for each
   split at most, are put together from step 1.

A quote opens a field only at its start, a doubled quote stays inside, and what follows
a closing quote up to the comma belongs to the field.  A file is read twice; no line is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import shared_root

_ROWS = 4096


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``, given whether one is open before it."""
    at = 0
    while True:
        if not inside:  # at the start of a field
            if line[at:at + 1] == '"':
                inside, at = True, at + 1
                continue
            at = line.find(",", at) + 1
            if not at:
                return False
        else:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line[quote + 1:quote + 2] == '"':
                at = quote + 2
                continue
            inside, at = False, line.find(",", quote + 1) + 1
            if not at:
                return False


class _Run:
    """The records of one split from one start state."""

    def __init__(self, inside: bool):
        self.inside = inside
        self.head: list[str] | None = [] if inside else None  # lines of the record that the split starts in
        self.open: list[str] = []
        self.started_inside = inside

    def add(self, line: str, quoted: bool) -> str | None:
        """Takes the next line; a record that is complete with it and began in this split."""
        after = inside_after(line, self.inside) if quoted else self.inside
        before, self.inside = self.inside, after
        if before and not self.open and self.started_inside:
            self.head.append(line)
            if not after:
                self.started_inside = False
            return None
        self.open.append(line)
        if after:
            return None
        record, self.open = "\n".join(self.open), []
        return record


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(files)
    return rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], list[bool]]]:
    """(path, split start, lines, whether each has a quote), in file order; a split spans several items."""
    for b in batches:
        for k in range(0, b.num_rows, _ROWS):
            some = b.slice(k, _ROWS)
            lines, start = some.column("value").to_pylist(), some.column("start").to_numpy()
            path = some.column("path").dictionary_encode() if not pa.types.is_dictionary(some.column("path").type) else some.column("path")
            code = path.indices.to_numpy()
            quoted = pc.match_substring(some.column("value"), '"').to_pylist()
            new = np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1
            cuts = [0, *new.tolist(), len(lines)] if len(lines) else []
            for a, z in zip(cuts, cuts[1:]):
                yield path.dictionary[int(code[a])].as_py(), int(start[a]), lines[a:z], quoted[a:z]


_EDGES = "path string, start bigint, inside boolean, ends_inside boolean, head string, closed boolean, tail string"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for each split: what it does from either start state."""
    current, runs = None, []

    def rows():
        out = []
        for inside, r in zip((False, True), runs):
            out.append((*current, inside, r.inside, None if r.head is None else "\n".join(r.head), not r.started_inside, "\n".join(r.open) if r.open else None))
        cols = list(zip(*out))
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["path", "start", "inside", "ends_inside", "head", "closed", "tail"])

    for path, start, lines, quoted in _splits(batches):
        if (path, start) != current:
            if current is not None:
                yield rows()
            current, runs = (path, start), [_Run(False), _Run(True)]
        for r in runs:
            for line, q in zip(lines, quoted):
                r.add(line, q)
    if current is not None:
        yield rows()


def csv_records(spark: SparkSession, files: Iterable[str]) -> DataFrame:
    """(record, path): every record of the CSV files but their first, the header; blank lines are no records."""
    files = list(files)
    path = f"{shared_root(spark)}/basketry-io/edges-{uuid.uuid4().hex[:10]}"
    _lines(spark, files).mapInArrow(_edges, _EDGES).write.parquet(path)
    edges = spark.read.schema(_EDGES).parquet(path)

    ends: dict[str, list[tuple[int, bool, bool]]] = {}
    for r in edges.groupBy("path", "start").agg(F.bool_or(~F.col("inside") & F.col("ends_inside")).alias("out"), F.bool_or(F.col("inside") & F.col("ends_inside")).alias("ins")).toLocalIterator():
        ends.setdefault(r.path, []).append((r.start, r.out, r.ins))
    state: dict[tuple[str, int], bool] = {}
    known = []
    for name, some in ends.items():
        inside = False
        for order, (start, after_out, after_in) in enumerate(sorted(some)):
            state[name, start] = inside
            known.append((name, start, inside, order))
            inside = after_in if inside else after_out
    table = spark.sparkContext.broadcast(state)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, run, skip = None, None, False
        for name, start, lines, quoted in _splits(batches):
            if (name, start) != current:
                if (name, start) not in table.value:
                    raise RuntimeError(f"{name} was split in another way than in the first scan")
                current, run, skip = (name, start), _Run(table.value[name, start]), start == 0
            done = [r for line, q in zip(lines, quoted) if (r := run.add(line, q)) is not None]
            if skip and done:
                done, skip = done[1:], False
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array([name] * len(done), pa.string())], ["record", "path"])

    inner = _lines(spark, files).mapInArrow(whole, "record string, path string")
    starts = spark.createDataFrame(known, "path string, start bigint, inside boolean, nth int")
    mine = edges.join(starts, ["path", "start", "inside"])
    # a record across splits: the open end of one, whole splits inside it, and the head that closes it
    head = mine.where("inside").select("path", F.col("nth"), F.lit(0).alias("side"), F.col("head").alias("piece"), F.col("closed"))
    tail = mine.where("tail is not null").select("path", F.col("nth"), F.lit(1).alias("side"), F.col("tail").alias("piece"), F.lit(False).alias("closed"))
    pieces = head.unionAll(tail)
    number = F.sum("side").over(_in_file())
    joined = pieces.withColumn("of", number).groupBy("path", "of").agg(F.sort_array(F.collect_list(F.struct("nth", "side", "piece"))).alias("p"))
    across = joined.select(F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("record"), "path")
    cr = F.endswith("record", F.lit("\r"))
    out = inner.unionAll(across).withColumn("record", F.when(cr, F.expr("substring(record, 1, length(record) - 1)")).otherwise(F.col("record")))
    return out.where(F.trim("record") != "")


def _in_file():
    """Pieces of one file in order; at most two for each of its splits."""
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("nth", "side").rowsBetween(Window.unboundedPreceding, 0)
