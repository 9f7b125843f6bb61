"""Loading raw files into tables: readers, sinks, audit, isolation.

* ``read_csv`` - header CSV with a declared schema (never inferred).  Columns are
  taken by the names in each file's header, whatever their order (``headers``);
  undeclared ones are left out, missing ones are an error.  A UTF-8 byte-order mark is
  tolerated.  Files with quoted line breaks (``multi_line``) are read by many tasks (``records``).
* ``read_csv_tolerant`` - the documented variant: malformed rows are set
  aside (PERMISSIVE mode with a corrupt-record column) and the load fails
  when more than ``max_bad_rows`` are found.
* ``rename_translation`` - the category translation file's columns become
  ``string_field_0`` / ``string_field_1``.
* ``published.replace`` - full refresh of a table: written aside by one job, then
  switched; a failed job leaves the previous rows in place.
* ``write_full_refresh`` - the same for a plain folder without a manifest: staged, then put in its place by renames.
* ``jdbc_options`` / ``read_jdbc`` - a partitioned parallel JDBC read.
* ``load_tables`` - load a list of tables, one job each; a missing file, a missing column or a
  failing table becomes a status row in the audit, keeps the table's previous rows, and the others continue.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from basketry.session import shared_root
from basketry.sources import files, headers, published
from basketry.sources.records import csv_records

CORRUPT = "_corrupt_record"
MAX_BAD_ROWS = 50

TRANSLATION_COLUMNS = {"product_category_name": "string_field_0", "product_category_name_english": "string_field_1"}


class TooManyBadRows(ValueError):
    pass


def _struct(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _parse(spark: SparkSession, group: headers.HeaderGroup, schema: StructType, multi_line: bool, mode: str) -> DataFrame:
    """The rows of files with one header, in their own column order; ``schema`` says what each column is."""
    options = {"escape": '"', "mode": mode, "columnNameOfCorruptRecord": CORRUPT}
    if not multi_line:
        return spark.read.schema(schema).options(header=True, **options).csv(list(group.paths))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = csv_records(spark, group.paths).select(F.from_csv("record", ddl, options | {"multiLine": "true"}).alias("r"))
    return parsed.select("r.*")


def _read_by_name(spark: SparkSession, paths: str | list[str], schema: StructType, multi_line: bool, mode: str, corrupt: bool) -> DataFrame:
    groups = headers.header_groups(spark, paths)
    extra = [StructField(CORRUPT, StringType(), True)] if corrupt else []
    if not groups:  # no rows; an absent path is Spark's own error
        return spark.read.schema(StructType(schema.fields + extra)).csv(paths)
    headers.check(groups, schema)
    names = [f"`{n}`" for n in [*schema.names, *(f.name for f in extra)]]
    parts = [_parse(spark, g, StructType(g.parse_schema(schema).fields + extra), multi_line, mode).select(*names) for g in groups]
    return reduce(DataFrame.unionAll, parts)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, multi_line: bool = False) -> DataFrame:
    return _read_by_name(spark, path, _struct(schema), multi_line, "FAILFAST", False)


def read_csv_tolerant(spark: SparkSession, path: str | list[str], schema: StructType | str, max_bad_rows: int = MAX_BAD_ROWS,
                      multi_line: bool = False) -> tuple[DataFrame, int]:
    """Good rows and the number of malformed rows; raises above the limit.

    The parsed rows are written once as a table in the shared folder, as the corrupt
    column cannot be queried alone from a raw CSV scan; the same job counts the malformed ones.
    ``drop_staged`` removes that copy once the good rows have been used.
    """
    df = _read_by_name(spark, path, _struct(schema), multi_line, "PERMISSIVE", True)
    staged = f"{shared_root(spark)}/basketry-io/parsed-{uuid.uuid4().hex[:10]}"
    df.write.parquet(staged)
    df = spark.read.schema(df.schema).parquet(staged)
    bad = df.filter(F.col(CORRUPT).isNotNull()).count()
    if bad > max_bad_rows:
        files.remove(spark, staged)
        raise TooManyBadRows(f"{path}: {bad} malformed rows (limit {max_bad_rows})")
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), bad


def drop_staged(df: DataFrame) -> None:
    """Removes the copy that ``read_csv_tolerant`` staged for ``df``."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles() if "/basketry-io/parsed-" in f}
    for folder in folders:
        files.remove(df.sparkSession, folder)


def rename_translation(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in TRANSLATION_COLUMNS.items() if k in df.columns})


def write_full_refresh(df: DataFrame, path: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    """Replaces the plain folder ``path``: written beside it, then put in its place; a failed job leaves it as it was.

    Between the two renames the folder is absent for a moment; ``published.replace`` has no such moment.
    """
    spark = df.sparkSession
    aside, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    out = df.repartition(partitions) if partitions else df
    out.write.format(fmt).save(aside)
    p, fs = files.file_system(spark, path)
    if fs.exists(p):
        files.rename(spark, path, old)
    files.rename(spark, aside, path)
    files.remove(spark, old)


def write_csv(df: DataFrame, path: str, gzip_records: int | None = None) -> None:
    """CSV with header (export of a result or a raw extract); texts keep their outer blanks.

    ``gzip_records``: gzipped files of at most so many records, as a gzipped file has no splits.
    """
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if gzip_records:
        options |= {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": gzip_records}
    df.write.mode("overwrite").options(**options).csv(path)


def jdbc_options(url: str, table: str, partition_column: str | None = None, lower: int | None = None,
                 upper: int | None = None, num_partitions: int | None = None, fetch_size: int = 20_000,
                 batch_size: int = 10_000, **extra: str) -> dict[str, str]:
    """Options for a parallel JDBC read (and batched JDBC write).

    The source pulls ``SELECT *`` in 20,000-row chunks on one connection;
    here ``fetchsize`` keeps the same chunk and ``partitionColumn`` /
    ``numPartitions`` split the read into range queries run in parallel.
    """
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "batchsize": str(batch_size)}
    if partition_column is not None:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("partition_column needs lower, upper and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()


@dataclass(frozen=True)
class LoadSpec:
    """One file or folder to load; ``multi_line`` only for tables with quoted line breaks, whose files are scanned twice."""

    table: str
    path: str
    schema: StructType | str
    multi_line: bool = False


AUDIT_SCHEMA = "table string, status string, rows bigint, columns bigint, message string"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file system for this path finds anything there."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
        return True
    except AnalysisException:
        return False


def _load_one(spark: SparkSession, spec: LoadSpec, target_root: str) -> tuple:
    if not _exists(spark, spec.path):
        return spec.table, "missing", None, None, f"file not found: {os.path.basename(spec.path)}"
    try:
        schema = _struct(spec.schema)
        told = headers.check(headers.header_groups(spark, spec.path), schema)
        df = read_csv(spark, spec.path, schema, spec.multi_line)
        if spec.table == "category_name_translation":
            df = rename_translation(df)
        loaded = published.replace(df, f"{target_root}/{spec.table}", {"source": spec.path})
        return spec.table, "loaded", loaded.rows, len(df.columns), told
    except Exception as e:  # noqa: BLE001 - one failing table must not stop the others
        return spec.table, "failed", None, None, f"{type(e).__name__}: {e}"


def load_tables(spark: SparkSession, specs: Iterable[LoadSpec], target_root: str, threads: int = 4) -> DataFrame:
    """Load each CSV into the published table ``target_root/<table>`` (full refresh), up to ``threads``
    at once, and return the audit: one row per table with status, rows and columns.

    Rows are counted by the write job itself (an observed metric).  A table that is missing or fails keeps the
    rows of its last load; columns that no schema declares are named in the message of a loaded table.
    """
    with ThreadPoolExecutor(max_workers=threads) as pool:
        rows = list(pool.map(lambda spec: _load_one(spark, spec, target_root), specs))
    return spark.createDataFrame(rows, AUDIT_SCHEMA)
