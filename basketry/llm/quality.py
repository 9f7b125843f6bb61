"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

Every text is described by shares and shapes of its bytes, words and lines
(``FEATURES``), computed on whole Arrow batches.  Each number is cut into bins
at its quantiles over the learning rows, so the model is additive and free
in shape.  A document labelled 1 is preferred to one labelled 0; weights
minimise the logistic loss of the feature differences of such pairs, with a
ridge, by Newton's method.  The raw score's quantile at the share of label 0
among the learning rows is the threshold, and the score is the
logistic function of the distance to it.

Learning takes every labelled row.  Their features are cut into bins at quantiles that one sketch aggregate over
all of them finds (rank error 1 / 1,000; any edges are exact to score by), and stored as one byte a feature.  The rows are
dealt into blocks of about 4,096 by their place in the order (label, hash of doc_id), which gives every block its
share of both labels; pairs are drawn inside a block with its number as seed, each row of either label as often as the others
and at least once.  A Newton step is one pass over the blocks whose sums (some 330 x 330 numbers) are added up on
the executors; only the total comes to the driver.  Scoring is one scan, no shuffle.

Defined cases: null and empty texts have all-zero features and are scored like any text.  A null doc_id
is never held out and never learned from.  Of several labels of a doc_id the largest
counts; null labels are ignored.  Without rows of both classes every score is 0.5.
Repeated rows are scored each on their own; other columns are not read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import text as tx
from basketry.operators.placed import placed
from basketry.session import shared_root

BLOCK = 4096  # learning rows that meet in pairs
PAIRS = 8192  # pairs of a block, if its rows are fewer (at most 20 for a row)
BINS = 12


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_UPPER, _LETTER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes([*range(65, 91), *range(97, 123)])), _flags(bytes(range(48, 58)))
_WIDE = _flags(bytes(range(128, 256)))
_BYTES = {
    "upper": _UPPER, "letter": _LETTER, "digit": _DIGIT, "wide": _WIDE, "space": _flags(b" \t"), "line": _flags(b"\n"), "stop": _flags(b"."), "comma": _flags(b","),
    "cry": _flags(b"!?"), "bar": _flags(b"|"), "sign": _flags(b"#$%&*+=~^@"), "bracket": _flags(b"()[]{}<>/\\_"), "quote": _flags(b"\"'`-:;"),
}
FEATURES = [*_BYTES, "bytes", "words", "word_length", "word_spread", "long_words", "distinct", "top_word", "repeat_next", "line_words", "stops_per_word", "commas_per_word", "upper_per_letter", "entropy"]


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of numbers for every text of a slice."""
    n = np.diff(off)
    size = np.maximum(n, 1)
    sums = {}
    for name, flag in _BYTES.items():
        total = np.concatenate([[0], np.cumsum(flag[data], dtype=np.int64)])
        sums[name] = np.diff(total[off])
    starts, ends, firsts = tx.word_spans(data, off, tx.SPACED)
    words = np.diff(firsts)
    many = np.maximum(words, 1)
    length = np.concatenate([[0], np.cumsum(ends - starts)])
    square = np.concatenate([[0], np.cumsum((ends - starts) ** 2)])
    long = np.concatenate([[0], np.cumsum(ends - starts > 14)])
    mean = np.diff(length[firsts]) / many
    spread = np.sqrt(np.maximum(0, np.diff(square[firsts]) / many - mean ** 2))
    hashes = tx.word_hashes(tx.lower(data), starts, ends)
    same = np.concatenate([[0], np.cumsum(np.concatenate([hashes[1:] == hashes[:-1], [False]]) if len(hashes) else [])])
    distinct, top, entropy = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i in np.flatnonzero(words):
        _, counts = np.unique(hashes[firsts[i]:firsts[i + 1]], return_counts=True)
        distinct[i], top[i] = len(counts) / words[i] ** 0.8, counts.max() / words[i]
        p = counts / words[i]
        entropy[i] = -(p * np.log(p)).sum() / np.log(words[i] + 1)
    out = [sums[name] / size for name in _BYTES]
    out += [np.log1p(n), np.log1p(words), mean, spread, np.diff(long[firsts]) / many, distinct, top, np.diff(same[firsts]) / many]
    out += [words / (sums["line"] + 1), sums["stop"] / many, sums["comma"] / many, sums["upper"] / np.maximum(1, sums["letter"]), entropy]
    return np.column_stack(out)


@dataclass
class Ranking:
    """Bin edges of each feature, weights of the bins, and the threshold of the raw score."""

    edges: list[np.ndarray]
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = _binned(x, self.edges) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold, -30, 30)))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Indicators "above the k-th edge" of every feature."""
    return np.concatenate([(x[:, [j]] > e[None, :]) for j, e in enumerate(edges)], axis=1).astype(float) if len(x) else np.zeros((0, sum(map(len, edges))))


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of every feature: how many edges lie below the number."""
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def _indicators(codes: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """``_binned`` from the bin numbers."""
    return np.concatenate([codes[:, [j]] > np.arange(len(e))[None, :] for j, e in enumerate(edges)], axis=1).astype(float)


def _differences(block: dict, edges: list[np.ndarray]) -> np.ndarray:
    """Feature differences of the pairs of a block, the better text first."""
    good, bad = (np.frombuffer(block[k], np.uint8).reshape(-1, len(edges)) for k in ("good", "bad"))
    if not len(good) or not len(bad):
        return np.zeros((0, sum(map(len, edges))))
    rng, most = np.random.default_rng([7, block["block"]]), max(len(good), len(bad))
    pairs = most * min(20, max(1, PAIRS // most))
    a = np.concatenate([rng.permutation(len(good)) for _ in range(-(-pairs // len(good)))])[:pairs]
    b = np.concatenate([rng.permutation(len(bad)) for _ in range(-(-pairs // len(bad)))])[:pairs]
    return _indicators(good, edges)[a] - _indicators(bad, edges)[b]


def _newton_sums(blocks: DataFrame, edges: list[np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss over the pairs of all blocks."""
    k = len(w)

    def part(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            for block in batch.to_pylist():
                d = _differences(block, edges)
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance given to the wrong order
                total[:k] += (d.T * (p * (1 - p))) @ d
                total[k] += d.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(table):
        v = table.column("v").combine_chunks()
        total = v.flatten().to_numpy().reshape(-1, k).sum(axis=0)
        return pa.table({"i": table.column("i")[:1], "v": pa.array([total], pa.list_(pa.float64()))})

    sums = blocks.mapInArrow(part, "i int, v array<double>").groupBy("i").applyInArrow(add, "i int, v array<double>").collect()
    by = {r["i"]: np.array(r["v"]) for r in sums}
    return by[k], np.array([by[i] for i in range(k)])


def fit(rows: DataFrame, ridge: float = 3.0) -> Ranking | None:
    """Bradley-Terry: P(a over b) = logistic(w . (a - b)), for pairs of a (label 1) and b (label 0).

    ``rows`` (doc_id, x, y): every labelled row with its features, none left out.
    """
    spark = rows.sparkSession
    h = F.xxhash64("doc_id", "x")
    spread, _ = placed(rows.select("x", F.col("y").cast("int").alias("y"), h.alias("h")), [("y", True), ("h", False)])
    n, m = spread.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < m < n:
        return None
    rare = F.col("y") == (1 if 2 * m < n else 0)
    width, cuts = len(FEATURES), [k / BINS for k in range(1, BINS)]
    asked = [F.percentile_approx(F.get("x", F.lit(j)), cuts, 1000) for j in range(width)]
    # the rarer label has its own quantiles too: what sets it apart may lie in one tail
    asked += [F.percentile_approx(F.when(rare, F.get("x", F.lit(j))), [0.1, 0.5, 0.9], 1000) for j in range(width)]
    got = spread.agg(*asked).first()
    edges = [np.union1d(got[j], got[width + j]) for j in range(width)]
    count = max(1, min(m, n - m, -(-n // BLOCK)))

    def code(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("y"), pa.array([c.tobytes() for c in _codes(x, edges)], pa.binary())], ["block", "y", "c"])

    def gather(table):
        y, c = table.column("y").to_numpy(), table.column("c").to_pylist()
        c = sorted(zip(y.tolist(), c))  # the same pairs in whichever order the rows arrive
        return pa.table({"block": table.column("block")[:1], "good": [b"".join(v for k, v in c if k)], "bad": [b"".join(v for k, v in c if not k)]})

    coded = spread.select(F.pmod("__pos", F.lit(count)).alias("block"), "y", "x").mapInArrow(code, "block bigint, y int, c binary")
    kept = f"{shared_root(spark)}/basketry-quality/{uuid.uuid4().hex}"
    coded.groupBy("block").applyInArrow(gather, "block bigint, good binary, bad binary").write.parquet(kept)
    blocks = spark.read.schema("block bigint, good binary, bad binary").parquet(kept)

    w = np.zeros(sum(map(len, edges)))
    for _ in range(25):
        slope, curve = _newton_sums(blocks, edges, w)
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), slope - ridge * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break

    def raw(batches):
        for b in batches:
            for block in b.to_pylist():
                codes = np.frombuffer(block["good"] + block["bad"], np.uint8).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([pa.array(_indicators(codes, edges) @ w)], ["raw"])

    share = (n - m) / n
    low, high = blocks.mapInArrow(raw, "raw double").agg(F.percentile_approx("raw", [share, min(1.0, share + 1 / n)], 100_000)).first()[0]
    return Ranking(edges, w, float((low + high) / 2))


def learn(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fold_of: int = 3, held: int = 1) -> Ranking | None:
    """Fits on every labelled row outside the held-out fold; features (26 numbers a row) are measured before the join, so no text is shuffled."""
    def taught(c):
        return F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(fold_of)) != held

    one = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("double").alias("y"))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & taught("doc_id"))

    def measure(batches):
        for b in batches:
            for part, data, off in tx.slices(b, "text"):
                x = features(data, off)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(measure, f"doc_id {kind}, x array<double>").join(one.where(taught("__id")), F.col("doc_id") == F.col("__id"))
    return fit(measured.select("doc_id", "x", (F.col("y") > 0).cast("int").alias("y")))


def rate(docs: DataFrame, ranking: Ranking | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scan(batches):
        model = shared.value
        for b in batches:
            for part, data, off in tx.slices(b, "text"):
                score = model.score(features(data, off)) if model else np.full(len(part), 0.5)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = rate(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
