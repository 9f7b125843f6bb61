"""Column names of CSV files: which declared columns each file has, in which order.

One open for each file, in a thread pool, reads its first record.  Files of
the same header are read together; each group is parsed in its own column order and
projected by name, so files of one table may order their columns differently.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from basketry.sources import files
from basketry.sources.records import inside_after


class ColumnsDiffer(ValueError):
    """A file lacks declared columns, or names a column twice."""


@dataclass(frozen=True)
class HeaderGroup:
    """Files with one header: ``names`` as in the files."""

    names: tuple[str, ...]
    paths: tuple[str, ...]

    def missing(self, schema: StructType) -> list[str]:
        return [f.name for f in schema.fields if f.name not in self.names]

    def unknown(self, schema: StructType) -> list[str]:
        return [n for n in self.names if n not in schema.names]

    def parse_schema(self, schema: StructType) -> StructType:
        """The declared types in the files' order; undeclared columns are text."""
        types = {f.name: f.dataType for f in schema.fields}
        return StructType([StructField(n, types.get(n, StringType()), True) for n in self.names])


def _open_quote(text: str) -> bool:
    inside = False
    for line in text.split("\n"):
        inside = inside_after(line, inside)
    return inside


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    text = files.first_lines(spark, path, _open_quote).removeprefix("﻿")
    return tuple(n.strip() for n in next(csv.reader([text], strict=False), ())) if text.strip() else ()


def header_groups(spark: SparkSession, paths: str | Iterable[str], threads: int = 16) -> list[HeaderGroup]:
    """The non-empty files of ``paths`` by their header."""
    found = [p for p, n in files.data_files(spark, paths) if n]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        headers = list(pool.map(lambda p: header_of(spark, p), found))
    groups: dict[tuple[str, ...], list[str]] = {}
    for p, names in zip(found, headers):
        if names:
            groups.setdefault(names, []).append(p)
    return [HeaderGroup(n, tuple(p)) for n, p in sorted(groups.items())]


def check(groups: list[HeaderGroup], schema: StructType) -> str | None:
    """Raises where declared columns are missing or a name is there twice; else what is to be told, if anything."""
    wrong, told = [], []
    for g in groups:
        name = g.paths[0].rpartition("/")[2] + (f" and {len(g.paths) - 1} more" if len(g.paths) > 1 else "")
        twice = sorted({n for n in g.names if g.names.count(n) > 1})
        if gone := g.missing(schema):
            wrong.append(f"missing columns in {name}: {', '.join(gone)}")
        if twice:
            wrong.append(f"columns named twice in {name}: {', '.join(twice)}")
        if more := g.unknown(schema):
            told.append(f"unknown columns in {name}: {', '.join(more)}")
    if wrong:
        raise ColumnsDiffer("; ".join(wrong))
    return "; ".join(told) or None
