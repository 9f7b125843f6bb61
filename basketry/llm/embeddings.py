"""Embedding near-dedup by epsilon grid order.

Vectors with equal, non-null labels link when their cosine in double
precision is at least ``threshold``.  On the unit sphere that is a distance of at
most eps = sqrt(2 - 2 * threshold), and a projection on orthonormal directions
never lengthens a distance.

1. Equal vectors of one label become one class with a count.
2. The covariance of all unit vectors (d x d sums, added up on the executors) gives
   the leading principal directions; a vector's cell is floor(projection / eps) in
   each of them.
3. Epsilon grid order: a range sort by (label, cell, ...) cut into blocks of
   at most ``block`` vectors.  A block's vectors with equal cells in the first three
   directions are a part; parts meet by an equi-join on these cells and their neighbours,
   and those more than one cell apart in another direction never do.  A pair
   of blocks gets only the parts that meet one of the other block.
4. Each pair of blocks is joined recursively: the longer interval is halved,
   intervals provably distant are skipped, and small ones are multiplied.  Only
   link counts and a spanning set of links leave a pair, never all its pairs.
5. Components over the links.

A group of thousands of equal vectors is one class, a group of many near copies
fills several blocks that are joined in different tasks.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components, or whose label is null, links with nothing and is its own component.
Vectors of different lengths never link.  Every row is a vertex of its own: repeated
vec_ids give several rows; a null vec_id is ignored when the smallest is taken.
Empty tables give empty results; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.store import components, written

GRID_DIMS = 6
_KEY_DIMS = 3  # leading directions whose cells are the key of the blocks' equi-join
_LEAF = 256


def _classes(rows: DataFrame) -> DataFrame:
    """(vec_id, cid, label, dim, vec): cid a digest of label and vector, null where the vector can't link; vec as doubles."""

    def prepare(batches):
        for b in batches:
            cid, dim, vec = [], [], []
            for v, lab in zip(b.column("vec").to_pylist(), b.column("label").to_pylist()):
                x = None if v is None or lab is None or any(c is None for c in v) else np.array(v, float) + 0.0
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any() or not np.isfinite(norm := np.linalg.norm(x)) or norm == 0:
                    cid.append(None)
                    dim.append(None)
                    vec.append(None)
                    continue
                cid.append(hashlib.blake2b(x.tobytes(), digest_size=16, salt=hashlib.blake2b(repr(lab).encode(), digest_size=16).digest()).digest())
                dim.append(len(x))
                vec.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(cid, pa.binary()), pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], ["vec_id", "label", "cid", "dim", "vec"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(prepare, f"vec_id {kinds['vec_id']}, label {kinds['label']}, cid binary, dim int, vec binary")


def _unit(vecs, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(classes: DataFrame, dims: int) -> dict[int, np.ndarray]:
    """Vector length -> leading principal directions; d x d numbers for each length that occurs."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            pdf = b.to_pandas()
            for d, some in pdf.groupby("dim"):
                x = _unit(some["vec"], int(d))
                total[int(d)] = total.get(int(d), 0) + np.vstack([x.T @ x, x.sum(axis=0), np.full(int(d), float(len(x)))])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["dim", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "sums": [np.sum([np.frombuffer(s) for s in pdf["sums"]], axis=0).tobytes()]})

    got = classes.select("dim", "vec").mapInArrow(sums, "dim int, sums binary").groupBy("dim").applyInPandas(add, "dim int, sums binary")
    out = {}
    for r in got.toLocalIterator():
        s = np.frombuffer(r["sums"]).reshape(r.dim + 2, r.dim)
        n = max(1.0, s[-1, 0])
        mean = s[-2] / n
        _, vectors = np.linalg.eigh(s[:-2] / n - np.outer(mean, mean))
        out[r.dim] = vectors[:, ::-1][:, :dims].copy()
    return out


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components so far, with the links a-b added; a component is named by its smallest member."""
    while True:
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (parent != parent[parent]).any():
            parent = parent[parent]


class _Join:
    """Recursive join of two sequences in epsilon grid order (or of one with itself)."""

    def __init__(self, cells, units, raw, norms, counts, threshold):
        self.cells, self.units, self.raw, self.norms, self.counts, self.threshold = cells, units, raw, norms, counts, threshold
        self.total = np.zeros(len(cells), np.int64)
        self.parent = np.arange(len(cells))

    def join(self, a: int, b: int, c: int, d: int) -> None:
        x, y = self.cells[a:b], self.cells[c:d]
        if not len(x) or not len(y) or (x.min(axis=0) > y.max(axis=0) + 1).any() or (y.min(axis=0) > x.max(axis=0) + 1).any():
            return
        same = (a, b) == (c, d)
        if b - a <= _LEAF and d - c <= _LEAF:
            return self._leaf(a, b, c, d, same)
        if same:
            m = (a + b) // 2
            self.join(a, m, a, m)
            self.join(m, b, m, b)
            self.join(a, m, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            self.join(a, m, c, d)
            self.join(m, b, c, d)
        else:
            m = (c + d) // 2
            self.join(a, b, c, m)
            self.join(a, b, m, d)

    def _leaf(self, a, b, c, d, same) -> None:
        cosine = self.units[a:b] @ self.units[c:d].T
        yes = cosine >= self.threshold
        for i, j in np.argwhere(np.abs(cosine - self.threshold) < 1e-12):  # the edge: by the plain formula
            yes[i, j] = float(self.raw[a + i] @ self.raw[c + j]) / (self.norms[a + i] * self.norms[c + j]) >= self.threshold
        if same:
            np.fill_diagonal(yes, True)
        self.total[a:b] += yes @ self.counts[c:d]
        if not same:
            self.total[c:d] += yes.T @ self.counts[a:b]
        i, j = np.nonzero(yes)
        self.parent = _hook(self.parent, a + i, c + j)


def _near_cells(blocked: DataFrame, cs: list[str]) -> DataFrame:
    """(i, j, block, leading cells): the parts of blocks i <= j, by their leading cells, that the join of this pair needs.

    A block's part is a row with its leading cells and the ranges of its other cells.  Parts meet
    by an equi-join on the leading cells, one side repeated for the cells around it; two parts more
    than one cell apart in another direction are dropped.  Vectors that link always lie in parts that meet,
    and every part meets itself.
    """
    lead, rest = cs[:_KEY_DIMS], cs[_KEY_DIMS:]
    ends = [f(c).alias(f"{n}{c}") for c in rest for n, f in (("lo", F.min), ("hi", F.max))]
    parts = written(blocked.groupBy("block", "label", "dim", *lead).agg(F.count(F.lit(1)).alias("size"), *ends), "parts")
    around = parts
    for c in lead:
        around = around.withColumn(f"at_{c}", F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    other = parts.select(*[F.col(c).alias(f"r_{c}") for c in parts.columns])
    near = (F.col("label") == F.col("r_label")) & (F.col("dim") == F.col("r_dim")) & (F.col("block") <= F.col("r_block"))
    for c in lead:
        near &= F.col(f"at_{c}") == F.col(f"r_{c}")
    for c in rest:
        near &= (F.col(f"lo{c}") <= F.col(f"r_hi{c}") + 1) & (F.col(f"r_lo{c}") <= F.col(f"hi{c}") + 1)
    sides = F.array(*[F.struct(F.col(f"{r}block").alias("block"), *[F.col(f"{r}{c}").alias(c) for c in lead]) for r in ("", "r_")])
    met = around.join(other, near).select(F.col("block").alias("i"), F.col("r_block").alias("j"), F.explode(sides).alias("part"))
    return met.select("i", "j", "part.*").distinct()


def near_duplicates(rows: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 2048, dims: int = GRID_DIMS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    prepared = written(_classes(rows), "vectors")
    classes = written(prepared.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("many"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    sc = rows.sparkSession.sparkContext
    directions = sc.broadcast(_directions(classes, dims))

    def place(batches):
        for b in batches:
            pdf = b.to_pandas()
            cells = np.zeros((len(pdf), dims), np.int64)
            for d, at in pdf.groupby("dim").indices.items():
                got = np.floor(_unit(pdf["vec"].iloc[at], int(d)) @ directions.value[int(d)] / eps).astype(np.int64)
                cells[at, :got.shape[1]] = got
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cells[:, k]) for k in range(dims))], [*b.schema.names, *(f"c{k}" for k in range(dims))])

    cs = [f"c{k}" for k in range(dims)]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    placed = classes.mapInArrow(place, ddl + "".join(f", {c} bigint" for c in cs))

    def number(batches):
        """Consecutive rows of one label and length, at most ``block``, get one block number."""
        part = _partition()
        at, size, last = -1, 0, None
        for b in batches:
            labels, lengths = b.column("label").to_pylist(), b.column("dim").to_pylist()
            out = []
            for key in zip(labels, lengths):
                if key != last or size >= block:
                    at, size, last = at + 1, 0, key
                size += 1
                out.append((part << 32) + at)
            yield b.append_column("block", pa.array(out, pa.int64()))

    order = ["label", "dim", *cs, "cid"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocked = written(ordered.mapInArrow(number, ddl + "".join(f", {c} bigint" for c in cs) + ", block bigint"), "blocks")
    pairs = _near_cells(blocked, cs)
    dealt = blocked.select("block", "cid", "many", "dim", "vec", *cs).join(pairs, ["block", *cs[:_KEY_DIMS]])

    def join_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", *cs, "cid"]).reset_index(drop=True)
        d = int(pdf["dim"].iloc[0])
        raw = np.frombuffer(b"".join(pdf["vec"]), float).reshape(-1, d)
        work = _Join(pdf[cs].to_numpy(), _unit(pdf["vec"], d), raw, np.linalg.norm(raw, axis=1), pdf["many"].to_numpy(), threshold)
        first = int((pdf["block"] == pdf["i"].iloc[0]).sum())
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            work.join(0, len(pdf), 0, len(pdf))
        else:
            work.join(0, first, first, len(pdf))
        cid = pdf["cid"].to_numpy()
        some = (work.total > 0) | (work.parent != np.arange(len(pdf)))
        return pd.DataFrame({"cid": cid[some], "links": work.total[some], "root": cid[work.parent[some]]})

    joined = written(dealt.groupBy("i", "j").applyInPandas(join_pair, "cid binary, links bigint, root binary"), "links")
    totals = joined.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = written(components(joined.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vectors"), "vector-roots")
    named = classes.select("cid", "low").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(totals, "cid", "left")
    named = named.select("cid", "low", F.coalesce("root", "cid").alias("root"), "links")
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lows, "root").select("cid", "component", "links")
    out = prepared.select("vec_id", "cid").join(named, "cid", "left")
    out = out.select("vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT low.vec_id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, low.vec_id = component_id AS kept
FROM low LEFT JOIN n ON low.vec_id = n.vec_id
"""
