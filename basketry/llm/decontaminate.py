"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window
is ``n`` consecutive words of an item; an item of fewer words, but not none,
is one window.  Every window hash of a text is looked up in the set, each hit
is verified word by word, and a text word inside any verified occurrence is
hit.  One scan of the texts, no shuffle of them.

The set is broadcast while the benchmark has at most ``max_windows`` distinct windows, a
documented bound.  Beyond it nothing that grows is broadcast (``_joined``): texts look their
windows up in a bitmap of fixed size (16 MB), the places that pass are shuffled by window hash to the
benchmark's windows, verified word by word in the join, and the hits of each distinct text are
joined back by its sha256.

Defined cases: null or empty text: no words, no hit, clean; very long texts are scanned
whole.  Items of null or empty text have no window.  An item with a null id has its
windows like any other; all such items together count as one in ``n_items`` and add nothing to ``items_sha256``.
Equal windows of several items count for each of them; repeated item ids count once.
Rows with a repeated or null doc_id are rated each on their own.  Empty
tables give empty results or clean documents.  Columns of other names are
carried untouched by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import text as tx
from basketry.llm.store import written

BITS = 20
JOIN_BITS = 27  # of the bitmap beyond the broadcast's bound


class _Windows:
    """The windows of a benchmark: words -> item ids, with hash tables by length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.items = windows
        self.tables = {}
        by_len: dict[int, list[tuple[bytes, ...]]] = {}
        for w in windows:
            by_len.setdefault(len(w), []).append(w)
        for n, ws in by_len.items():
            flat = b" ".join(b" ".join(w) for w in ws)
            data = np.frombuffer(flat, np.uint8)
            starts, ends, _ = tx.word_spans(data, np.array([0, len(data)]), tx.ALNUM)
            hashes = np.unique(tx.window_hashes(tx.word_hashes(data, starts, ends), n)[::n])
            quick = np.zeros(1 << BITS, bool)
            quick[hashes >> np.uint64(64 - BITS)] = True
            self.tables[n] = hashes, quick

    def hits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, list[str]]]]:
        """Words per row, and (row, first word, words, item ids) of every verified occurrence."""
        starts, ends, firsts = tx.word_spans(data, off, tx.ALNUM)
        words = tx.word_hashes(data, starts, ends)
        found = []
        raw = None
        for n, (hashes, quick) in self.tables.items():
            h = tx.window_hashes(words, n)
            at = np.flatnonzero(quick[h >> np.uint64(64 - BITS)])
            if not len(at):
                continue
            pos = np.searchsorted(hashes, h[at])
            at = at[hashes[np.minimum(pos, len(hashes) - 1)] == h[at]]
            if not len(at):
                continue
            rows = np.searchsorted(firsts, at, "right") - 1
            keep = at + n <= firsts[rows + 1]
            raw = raw if raw is not None else data.tobytes()
            for i, r in zip(at[keep].tolist(), rows[keep].tolist()):
                ids = self.items.get(tuple(raw[a:b] for a, b in zip(starts[i:i + n].tolist(), ends[i:i + n].tolist())))
                if ids is not None:
                    found.append((r, i - int(firsts[r]), n, ids))
        return np.diff(firsts), found


def _item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode().translate(tx.LOWER_TABLE), np.uint8)
    starts, ends, _ = tx.word_spans(data, np.array([0, len(data)]), tx.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def item_windows(benchmark: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(part, window array<binary>, items array<string>): the distinct windows of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wins = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = _item_words(t)
                for k in range(max(1, len(w) - n + 1) if w else 0):
                    ids.append(i)
                    wins.append(w[k:k + n])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.list_(pa.binary()))], ["item", "window"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    rows = rows.mapInArrow(cut, "item string, window array<binary>")
    held = rows.groupBy("window").agg(F.collect_set("item").alias("items"), F.max(F.col("item").isNull()).alias("nameless"))
    return held.select("window", F.when(F.col("nameless"), F.concat("items", F.array(F.lit(None).cast("string")))).otherwise(F.col("items")).alias("items"))


def _digest_of(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest()


def _covered(spans: list[tuple[int, int]], words: int) -> int:
    """Words inside any of the ranges."""
    edges = np.zeros(words + 1, np.int64)
    for a, z in spans:
        edges[a] += 1
        edges[z] -= 1
    return int((np.cumsum(edges) > 0).sum())


def _joined(base: DataFrame, windows: DataFrame, fields: list, ddl: str) -> DataFrame:
    """``rate`` for a benchmark of any size: places that pass a fixed bitmap meet the windows in a shuffle."""
    spark = base.sparkSession
    lengths = sorted(r[0] for r in windows.select(F.size("window")).distinct().toLocalIterator())  # at most n numbers

    def window_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1 << 12):
                some = b.slice(k, 1 << 12)
                flat = [b" ".join(w) for w in some.column("window").to_pylist()]
                data = np.frombuffer(b" ".join(flat), np.uint8)
                off = np.cumsum([0, *(len(w) + 1 for w in flat[:-1]), len(flat[-1])]) if flat else np.zeros(1, np.int64)
                starts, ends, firsts = tx.word_spans(data, off, tx.ALNUM)
                words = tx.word_hashes(data, starts, ends)
                h = [int(tx.window_hashes(words[a:z], z - a)[0]) for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(flat, pa.binary()), some.column("items")], ["h", "window", "items"])

    held = written(windows.mapInArrow(window_hash, "h bigint, window binary, items array<string>"), "windows")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - JOIN_BITS)).astype(np.int64))], ["bit"])

    words_of = held.select("h").mapInArrow(bits, "bit bigint").groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    bitmap = np.zeros(1 << JOIN_BITS >> 6, np.uint64)
    for r in words_of.toLocalIterator():  # at most 2 ** 21 words
        bitmap[r.word] = np.uint64(r.mask & (1 << 64) - 1)
    quick = spark.sparkContext.broadcast(bitmap)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = quick.value
        for b in batches:
            for rows, data, off in tx.slices(b, "__text"):
                data = tx.lower(data)
                starts, ends, firsts = tx.word_spans(data, off, tx.ALNUM)
                words, raw = tx.word_hashes(data, starts, ends), data.tobytes()
                for n in lengths:
                    h = tx.window_hashes(words, n)
                    bit = h >> np.uint64(64 - JOIN_BITS)
                    at = np.flatnonzero((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(firsts, at, "right") - 1
                    at = at[at + n <= firsts[row + 1]]
                    row = np.searchsorted(firsts, at, "right") - 1
                    for k in range(0, len(at), 1 << 14):
                        some, of = at[k:k + (1 << 14)], row[k:k + (1 << 14)]
                        flat = [b" ".join(raw[x:y] for x, y in zip(starts[i:i + n].tolist(), ends[i:i + n].tolist())) for i in some.tolist()]
                        yield pa.RecordBatch.from_arrays([rows.column("__sha").take(pa.array(of)), pa.array(h[some].view(np.int64)), pa.array(some - firsts[of]), pa.array(np.full(len(some), n)), pa.array(flat, pa.binary())], ["sha", "h", "first", "n", "seen"])

    texts = base.withColumn("__sha", F.sha2(F.coalesce("__text", F.lit("")), 256))
    found = texts.select("__sha", "__text").mapInArrow(places, "sha string, h bigint, first bigint, n bigint, seen binary")
    found = found.distinct().join(held, "h").where("seen = window").select("sha", "first", "n", "items")
    found = found.groupBy("sha").agg(F.collect_set(F.struct("first", "n")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    both = texts.join(found, texts["__sha"] == found["sha"], "left").drop("__sha", "sha")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, off in tx.slices(b, "__text"):
                counts = np.diff(tx.word_spans(tx.lower(data), off, tx.ALNUM)[2])
                spans, ids = rows.column("spans").to_pylist(), rows.column("ids").to_pylist()
                hit = [_covered([(s["first"], s["first"] + s["n"]) for s in x], c) if x else 0 for x, c in zip(spans, counts.tolist())]
                yield _rated(rows, fields, counts, np.array(hit, np.int64), [set(x or ()) for x in ids])

    return both.mapInArrow(finish, ddl)


def _rated(rows: pa.RecordBatch, fields: list, counts: np.ndarray, hit: np.ndarray, ids: list[set]) -> pa.RecordBatch:
    arrays = [rows.column(f.name) for f in fields]
    arrays += [pa.array(counts), pa.array(hit), pa.array([len(x) for x in ids], pa.int64()), pa.array([_digest_of(x) if x else _EMPTY for x in ids], pa.string()), pa.array(hit > 0)]
    return pa.RecordBatch.from_arrays(arrays, [*(f.name for f in fields), "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def rate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", max_windows: int = 200_000, clean: bool = False) -> DataFrame:
    """All columns of ``docs`` but ``text`` (prefixed ``d_``), n_words, n_hit, n_items, items_sha256, contaminated.

    With ``clean`` the text stays too, as column ``d_<text>``.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    windows = written(item_windows(benchmark, n, item), "benchmark")
    keep = [c for c in docs.columns if clean or c != text]
    base = docs.select(*[F.col(c).alias(f"d_{c}") for c in keep], F.col(text).alias("__text"))
    fields = [f for f in base.schema.fields if f.name != "__text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    ddl += (", " if ddl else "") + "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    if windows.count() > max_windows:
        return _joined(base, windows, fields, ddl)
    table = sc.broadcast({tuple(bytes(x) for x in r.window): r["items"] for r in windows.toLocalIterator()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(table.value)
        for b in batches:
            for rows, data, off in tx.slices(b, "__text"):
                spans: dict[int, list[tuple[int, int]]] = {}
                ids: list[set] = [set() for _ in range(len(rows))]
                counts, found = windows.hits(tx.lower(data), off)
                for r, at, m, some in found:
                    spans.setdefault(r, []).append((at, at + m))
                    ids[r].update(some)
                hit = np.zeros(len(rows), np.int64)
                for r, some in spans.items():
                    hit[r] = _covered(some, int(counts[r]))
                yield _rated(rows, fields, counts, hit, ids)

    return base.mapInArrow(scan, ddl)


_EMPTY = hashlib.sha256(b"").hexdigest()


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """The documents without a word in any benchmark window, with their own columns."""
    rated = rate(docs, benchmark, n, text, clean=True).where(~F.col("contaminated"))
    return rated.select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


SQL = """
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM doc_words, lengths WHERE len(w) >= n
),
hits AS (SELECT p.doc_id, p.k, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND array_to_string(p.w[p.k:p.k + p.n - 1], ' ') = x.g),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = rate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("d_doc_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
