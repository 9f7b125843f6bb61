"""Line dedup: two Bloom filters name the suspects, an exact count confirms them.

A text is split at \\n (null or empty: one empty line).  A line's key is the
line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  A key of at
least ``min_chars`` code points found in at least ``min_docs`` documents loses its
lines in all of them but the one with the largest doc_id.

1. Each task puts the key hashes of its rows into a "seen once" and a "seen
   twice" filter (by row) and sends them as sparse blocks of 65,536 bits.
   Blocks merge as twice = A.twice | B.twice | (A.once & B.once),
   once = A.once | B.once, as a stream in block order, so a key of two rows is always in "twice".
   A filter has 2**27 to 2**30 bits (16 to 128 MB, the bound of its broadcast),
   5.6 for each key; the keys are bounded by the counted lines and bytes of the
   input.  More keys than one filter of 2**30 bits takes are dealt by hash over several
   filters, each built and used in a scan of its own.  A key that is in one
   row only is suspected with a probability of at most (1 - exp(-3 / 5.6)) ** 3,
   7 %, at every size.
2. Only lines in the "twice" filter shuffle, as (128-bit digest, doc_id, hash of the
   text): an exact count of distinct documents and the largest doc_id.
   A key in more documents than an even share of a task is dealt in pieces.
3. The digests that a document loses are joined to each of its rows by doc_id and hash
   of the text, so the rows of one doc_id, or without any, don't share one list.  Their table is
   written first, so Spark's planner knows its size: it broadcasts a small one
   and otherwise shuffles.

Defined cases: rows with one doc_id are one document (a line kept there is kept in
all its rows); rows with a null doc_id are one document smaller than any other.
Very long texts are read whole, in slices of whole rows.  Null texts keep being null.  Empty tables give empty results.  Other columns are
carried unchanged (``n_chars`` follows the new text), whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import text as tx
from basketry.llm.store import written
from basketry.operators.hotkeys import FINER, PIECES, split_join

MIN_FILTER_BITS, MAX_FILTER_BITS = 27, 30
BITS_A_KEY = 5.6
_BLOCK_BITS = 16
_PROBES = 3
_STRIP = b" \t\n\x0b\x0c\r"


def _long_lines(data: np.ndarray, off: np.ndarray, min_chars: int):
    """(row, start, end, hash) of the stripped lines with enough code points; ``data`` is lower-cased."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(off[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))  # with the line break: it is stripped
    solid = np.flatnonzero(tx.SPACED[data])
    a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = np.flatnonzero(z > a)
    s, e = solid[a[some]], solid[z[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    enough = points[e] - points[s] >= min_chars
    s, e = s[enough], e[enough]
    return np.searchsorted(off, s, "right") - 1, s, e, tx.word_hashes(data, s, e, polynomial=len(data))  # a collision is one more suspect


@dataclass(frozen=True)
class Share:
    """One filter of ``of``: which keys it is for, and its size."""

    part: int
    of: int
    bits: int

    def takes(self, hashes: np.ndarray) -> np.ndarray:
        if self.of == 1:
            return np.ones(len(hashes), bool)
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(self.of) == self.part

    def probes(self, hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The block of each hash, and its bits inside the block."""
        block = (hashes >> np.uint64(64 - (self.bits - _BLOCK_BITS))).astype(np.int64)
        return block, [((hashes >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(_PROBES)]

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = self.probes(hashes)
        return np.unique(np.concatenate([(block << _BLOCK_BITS) | b for b in bits])) if len(hashes) else np.zeros(0, np.int64)


def shares(docs: DataFrame, min_chars: int, text: str) -> list[Share]:
    """Filters for all keys: at most one for each line, and for each ``min_chars`` bytes with a line break."""
    size, breaks = F.octet_length(text), F.char_length(text) - F.char_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    got = docs.where(F.col(text).isNotNull()).agg(F.sum(F.least(breaks + 1, F.floor((size + 1) / (min_chars + 1)))).alias("n")).first()
    return filters_for(int(got.n or 0))


def filters_for(keys: int) -> list[Share]:
    want = max(1, math.ceil(keys * BITS_A_KEY))
    bits = min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, (want - 1).bit_length()))
    of = -(-want // (1 << bits))
    return [Share(k, of, bits) for k in range(of)]


def twice_filter(docs: DataFrame, min_chars: int, text: str, share: Share) -> np.ndarray:
    """The "seen in two rows" filter over all documents, as packed bits."""

    def local(batches):
        """Sparse blocks of both filters for a bounded number of lines at a time; the merge adds them up."""
        held, rows_held = [], 0

        def blocks():
            seen, times = np.unique(np.concatenate(held), return_counts=True)
            once, twice = share.positions(seen), share.positions(seen[times > 1])
            ids, at = np.unique(once >> _BLOCK_BITS, return_index=True)
            cut = np.searchsorted(twice >> _BLOCK_BITS, np.append(ids, 1 << 62))
            at = np.append(at, len(once))
            low_once, low_twice = (once & 0xFFFF).astype(np.uint16), (twice & 0xFFFF).astype(np.uint16)
            return pa.RecordBatch.from_arrays([
                pa.array(ids), pa.array([low_once[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                pa.array([low_twice[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["block", "once", "twice"])

        for b in batches:
            for rows, data, off in tx.slices(b, text):
                row, _, _, h = _long_lines(tx.lower(data), off, min_chars)
                mine = share.takes(h)
                row, h = row[mine], h[mine]
                if len(h):
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    held.append(h[new])
                    rows_held += int(new.sum())
                if rows_held > 2_000_000:
                    yield blocks()
                    held, rows_held = [], 0
        if held:
            yield blocks()

    def merge(batches):
        """Rows come in block order: one block's bits are held at a time."""
        at, once, twice = None, None, None
        for b in batches:
            for block, o, t in zip(b.column("block").to_pylist(), b.column("once"), b.column("twice")):
                if block != at:
                    if at is not None:
                        yield packed(at, twice)
                    at, once, twice = block, np.zeros(1 << _BLOCK_BITS, bool), np.zeros(1 << _BLOCK_BITS, bool)
                o, t = np.frombuffer(o.as_buffer(), np.uint16), np.frombuffer(t.as_buffer(), np.uint16)
                twice[o[once[o]]] = True
                twice[t] = True
                once[o] = True
        if at is not None:
            yield packed(at, twice)

    def packed(block, twice):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["block", "bits"])

    found = docs.select(text).mapInArrow(local, "block bigint, once binary, twice binary")
    merged = found.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, bits binary")
    out = np.zeros(1 << (share.bits - 3), np.uint8)
    width = 1 << (_BLOCK_BITS - 3)
    for r in merged.toLocalIterator():  # at most 16,384 rows of 8 KB
        out[r.block * width:(r.block + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _suspected(bits: np.ndarray, share: Share, hashes: np.ndarray) -> np.ndarray:
    block, probes = share.probes(hashes)
    yes = share.takes(hashes)
    for p in probes:
        at = (block << _BLOCK_BITS) | p
        yes &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return yes


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(docs: DataFrame, min_chars: int, share: Share) -> DataFrame:
    """(key, doc_id, same): each suspected key of a share once for each row that holds it; ``docs`` has doc_id, text, same."""
    bits = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, min_chars, "text", share))

    def scan(batches):
        for b in batches:
            for rows, data, off in tx.slices(b, "text"):
                data = tx.lower(data)
                row, s, e, h = _long_lines(data, off, min_chars)
                yes = _suspected(bits.value, share, h)
                if not yes.any():
                    continue
                raw = data.tobytes()
                pairs = sorted({(r, _digest(raw[i:j])) for r, i, j in zip(row[yes].tolist(), s[yes].tolist(), e[yes].tolist())})
                at = pa.array([r for r, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k in pairs], pa.binary()), rows.column("doc_id").take(at), rows.column("same").take(at)], ["key", "doc_id", "same"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(docs.mapInArrow(scan, f"key binary, doc_id {kind}, same bigint"), "suspects")
    bits.destroy()
    return found


def _hot(confirmed: DataFrame) -> DataFrame:
    """(key, pieces) of the keys in more documents than an even share of a task: fewer keys than tasks."""
    tasks = int(confirmed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = confirmed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return confirmed.where(F.col("n") * tasks > total).select("key", F.ceil(F.col("n") * (FINER * tasks) / total).cast("int").alias(PIECES))


def losses(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, same, keys): the digests of the keys whose lines a document loses, for each of its texts (``same``: their xxhash64)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("same"))
    pairs = reduce(DataFrame.unionByName, [suspects(docs, min_chars, share) for share in shares(docs, min_chars, "text")])
    held = pairs.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
    confirmed = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    confirmed = written(confirmed, "confirmed")
    lost = split_join(pairs, confirmed.select("key", "keep"), "key", ["doc_id", "same"], _hot(confirmed))
    lost = lost.where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return written(lost.groupBy("doc_id", "same").agg(F.collect_set("key").alias("keys")), "losses")


def _kept(text: str | None, keys: list[bytes], min_chars: int) -> tuple[list[str], int]:
    """Lines that stay, and the number of lines that go."""
    lines = (text or "").split("\n")
    gone = set(keys)
    stay = []
    for line in lines:
        key = line.encode().strip(_STRIP).translate(tx.LOWER_TABLE)
        if len(key) < min_chars or _digest(key) not in gone:
            stay.append(line)
    return stay, len(lines) - len(stay)


def dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` as ``d_<name>`` (the text without its lost lines, if ``with_text``), n_lines, n_dropped, kept_sha256."""
    lost = losses(docs, min_chars, min_docs, doc_id, text).select(F.col("doc_id").alias("__id"), F.col("same").alias("__same"), F.col("keys").alias("__keys"))
    base = docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns])
    mine = F.col(f"d_{doc_id}").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"d_{text}")) == F.col("__same"))
    base = base.join(lost, mine, "left").drop("__id", "__same")
    fields = [f for f in base.schema.fields if f.name != "__keys" and (with_text or f.name != f"d_{text}")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines bigint, n_dropped bigint, kept_sha256 string"
    col = f"d_{text}"

    def apply(batches):
        for b in (whole.slice(k, 500) for whole in batches for k in range(0, len(whole), 500)):
            texts, keys = b.column(col), b.column("__keys")
            kept, lines, dropped, sha = [], [], [], []
            for t, k in zip(texts, keys):
                t = t.as_py()
                raw, gone = t, 0
                n = (t or "").count("\n") + 1
                if t and k.is_valid:
                    stay, gone = _kept(t, k.as_py(), min_chars)
                    raw = "\n".join(stay)
                lines.append(n)
                dropped.append(gone)
                sha.append(hashlib.sha256((raw or "").encode()).hexdigest())
                if with_text:
                    kept.append(raw)
            arrays = [pa.array(kept, pa.string()) if f.name == col else b.column(f.name) for f in fields]
            arrays += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in fields), "n_lines", "n_dropped", "kept_sha256"])

    return base.mapInArrow(apply, ddl)


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text") -> DataFrame:
    """The documents with their own columns and the lines that stay."""
    out = dedup(docs, min_chars, min_docs, "doc_id", text)
    length = F.when(F.col("n_dropped") > 0, F.char_length(f"d_{text}")).otherwise(F.col("d_n_chars")) if "n_chars" in docs.columns else None
    return out.select(*[(length.cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"d_{c}")).alias(c) for c in docs.columns])


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_text=False)
    return out.select(F.col("d_doc_id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


SQL = """
WITH lines AS (
  SELECT doc_id, k.pos AS pos, k.line AS line,
         translate(trim(k.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'line': x, 'pos': i})) AS k FROM documents)
),
confirmed AS (
  SELECT key, max(doc_id) AS keep FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id AS doc_id, count(*) AS n_lines,
       count(*) FILTER (c.key IS NOT NULL AND l.doc_id <> c.keep) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.key IS NULL OR l.doc_id = c.keep), '')) AS kept_sha256
FROM lines l LEFT JOIN confirmed c ON l.key = c.key
GROUP BY l.doc_id
"""
