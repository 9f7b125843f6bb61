"""Tables that change all at once: folders written aside and a numbered manifest that readers resolve.

A table is a folder with data folders, each written by one job, and
``_manifests/<number>.json``.  The manifest of the highest number names the
data folders that are the table now, with its schema and row count.  A writer
writes its rows into a new folder (``stage``) and then publishes a manifest: a
failed or killed job leaves a folder that no manifest names, and readers keep
the rows they had.  A number is claimed by creating a claim file that must not exist, and the
manifest appears under its name by one rename, so it is never seen half
written and two writers never share a number; the higher number wins.

A reader that has resolved a manifest goes on reading its folders after a newer
one is published.  ``vacuum`` removes what the last manifests no longer name, and stays
away from young folders, which a running job may be writing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketry.session import shuffles_dropped
from basketry.sources import files

MANIFESTS = "_manifests"


class NotPublished(LookupError):
    """The table has no manifest."""


@dataclass(frozen=True)
class Manifest:
    number: int
    folders: tuple[str, ...]  # names below the table's folder
    schema: StructType
    rows: int | None = None
    info: dict = field(default_factory=dict)


def stage(target: str) -> str:
    """The name of a new data folder of ``target``."""
    return f"data-{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, target: str, suffix: str) -> list[int]:
    names = [n for n, _, _ in files.children(spark, f"{target}/{MANIFESTS}")]
    return sorted(int(n.removesuffix(suffix)) for n in names if n.endswith(suffix) and n.removesuffix(suffix).isdigit())


def _path(target: str, number: int, suffix: str = ".json") -> str:
    return f"{target}/{MANIFESTS}/{number:010d}{suffix}"


def _load(spark: SparkSession, target: str, number: int) -> Manifest:
    d = json.loads(files.read_text(spark, _path(target, number)))
    return Manifest(number, tuple(d["folders"]), StructType.fromJson(d["schema"]), d["rows"], d["info"])


def current(spark: SparkSession, target: str) -> Manifest | None:
    """The newest manifest of the table, or none."""
    numbers = _numbers(spark, target, ".json")
    return _load(spark, target, numbers[-1]) if numbers else None


def publish(spark: SparkSession, target: str, folders: Sequence[str], schema: StructType, rows: int | None = None, info: dict | None = None) -> Manifest:
    """Makes ``folders`` (all written) the table, in one step."""
    number = max([0, *_numbers(spark, target, ".json"), *_numbers(spark, target, ".claim")])
    while True:
        number += 1
        try:
            files.write_text(spark, _path(target, number, ".claim"), "")
            break
        except Exception as e:  # the number is taken
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
    body = json.dumps({"folders": list(folders), "schema": schema.jsonValue(), "rows": rows, "info": info or {}})
    aside = _path(target, number, f".{uuid.uuid4().hex}.new")
    files.write_text(spark, aside, body)
    files.rename(spark, aside, _path(target, number))
    return _load(spark, target, number)


def _added(values: Sequence[str | None]) -> str | None:
    """The sum of a measure's values over the parts of a table, exactly; none if no part has a value."""
    known = [Decimal(v) for v in values if v is not None]
    return format(reduce(Context(prec=80).add, known), "f") if known else None


def replace(df: DataFrame | Sequence[DataFrame], target: str, info: dict | None = None, measures: dict[str, Column] | None = None) -> Manifest:
    """Full refresh: a job writes ``df`` aside and counts it; then the table is the new rows and nothing else.

    ``measures`` are aggregates that the same job observes; the manifest keeps their values, as text.
    Of a list of parts (of one schema), each is written by a job of its own into its own folder, one after
    another, so that the shuffle files of one part are on disk at a time; all are published together,
    and what was measured of them (counts and sums) is added up.
    """
    parts = [df] if isinstance(df, DataFrame) else list(df)
    spark, folders, got = parts[0].sparkSession, [], []
    asked = [m.cast("string").alias(name) for name, m in (measures or {}).items()]
    for part in parts:
        folder, seen = stage(target), Observation(f"rows-{uuid.uuid4().hex[:8]}")
        observed = part.observe(seen, F.count(F.lit(1)).alias("rows"), *asked)
        with shuffles_dropped(spark):
            observed.write.option("compression", "zstd").parquet(f"{target}/{folder}")
        folders.append(folder)
        got.append(seen.get)
    found = {name: got[0][name] if len(got) == 1 else _added([g[name] for g in got]) for name in measures or {}}
    return publish(spark, target, folders, parts[0].schema, sum(int(g["rows"]) for g in got), {**(info or {}), "measures": found})


def measured(spark: SparkSession, target: str, manifest: Manifest) -> DataFrame | None:
    """One row, read from the manifest: ``rows`` and what the write observed, as text; none if it observed nothing."""
    names = manifest.info.get("measures")
    if not names:
        return None
    fields = ", ".join(f"`{n}`: string" for n in names)
    return spark.read.schema(f"rows bigint, info struct<measures: struct<{fields}>>").json(_path(target, manifest.number)).select("rows", "info.measures.*")


def paths(target: str, manifest: Manifest) -> list[str]:
    return [f"{target}/{f}" for f in manifest.folders]


def read(spark: SparkSession, target: str, manifest: Manifest | None = None) -> DataFrame:
    """The table as its newest manifest (or the given one) has it."""
    m = manifest or current(spark, target)
    if m is None:
        raise NotPublished(target)
    if not m.folders:
        return spark.createDataFrame([], m.schema)
    return spark.read.schema(m.schema).parquet(*paths(target, m))


def read_parts(spark: SparkSession, target: str, manifest: Manifest) -> list[DataFrame]:
    """The manifest's table as one frame for each of its folders."""
    return [spark.read.schema(manifest.schema).parquet(p) for p in paths(target, manifest)]


def vacuum(spark: SparkSession, target: str, keep: int = 2, min_age_s: float = 24 * 3600) -> list[str]:
    """Removes all manifests but the last ``keep``, and data folders that these don't name and that are older than ``min_age_s``."""
    numbers = _numbers(spark, target, ".json")
    kept = {f for n in numbers[-keep:] for f in _load(spark, target, n).folders}
    for n in numbers[:-keep]:
        files.remove(spark, _path(target, n))
    before = (time.time() - min_age_s) * 1000
    gone = [n for n, _, at in files.children(spark, target) if n.startswith("data-") and n not in kept and at <= before]
    for n in gone:
        files.remove(spark, f"{target}/{n}")
    return gone
