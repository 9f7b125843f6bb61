"""Suffix-array dedup: removes every byte covered by a 50-byte string of an earlier document.

Texts are UTF-8 bytes (null: empty).  A byte goes if a string of ``length`` bytes
covering it also starts in a document with a smaller doc_id; strings are judged on
the input and never cross documents.

1. Equal texts are one node; copies with a larger doc_id go whole (if long enough).
2. Every window of ``length`` bytes has an anchor: the smallest hash of the
   ``GRAM``-byte strings in it.  Equal windows have equal anchors, so a window whose
   anchor no other node has is unique.  Anchors shuffle as (hash, node), sorted,
   and only those that several nodes have come back to their node.
3. Windows with a shared anchor are cut out as segments (windows with one anchor, with
   their bytes) and dealt by anchor, so equal windows meet in one shard; equal
   segments of a batch are merged before the shuffle, hot passages shrink there.
4. A shard comes sorted by anchor and is worked off in groups of whole anchors, about
   ``memory`` / 64 bytes of distinct segments each, so it may be far larger than memory.
   A group's segments are sorted by external induced sorting (``suffix.Suffixes``):
   neighbouring suffixes with a common prefix of ``length`` are equal windows.  The
   smallest doc_id of each class decides.  An anchor beyond twice the bound has its
   windows dealt by digest into parts on disk, which equal windows share.
5. Removed windows return to their node and its text (the second use of one shuffle of
   the texts) as byte intervals.

Defined cases: null and empty texts have nothing to remove.  Rows with a null
doc_id are one document before all others.  Rows with one doc_id are one document:
strings they share among themselves stay.  Repeated rows give one result row each.
Empty tables give empty results; other columns do not take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import text as tx
from basketry.llm.store import written
from basketry.llm.suffix import BLOCK, Scratch, Suffixes

LENGTH = 50
GRAM = 20
_LONGEST = 512  # windows in a segment
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1
_OCC = np.dtype([("node", "<i8"), ("id", "<i8"), ("at", "<i8")])
_LOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8")])
_WINDOW = np.dtype(_LOW.descr + [("node", "<i8"), ("at", "<i8")])
_PER_BYTE = 64  # of memory for each byte of a group
_FAN, _LEVELS = 16, 15  # digits of 64 bits of a window's digest
_ANCHOR = np.uint64((1 << 64) - (1 << 16))  # anchors have 48 bits: a chance match is one more segment, and zeros shuffle for nothing


def _anchors(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The smallest gram hash of every window of a slice (windows across texts are the caller's to drop)."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(tx._BYTE_VALUE[data] * tx._powers(tx._BASE, len(data)), out=sums[1:])
    low = tx.mix((sums[gram:] - sums[:-gram]) * tx._powers(tx._UNBASE, len(data) + 1)[:len(data) - gram + 1])
    span, width = 1, length - gram + 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return low & _ANCHOR


def _runs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs of windows with one anchor, none longer than the limit."""
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(low))
    if len(start) and int((end - start).max()) > _LONGEST:
        cut = [np.arange(a, z, _LONGEST) for a, z in zip(start.tolist(), end.tolist())]
        start = np.concatenate(cut)
        end = np.append(start[1:], len(low))
    return start, end


def _shared(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(node, anchors): for each node its anchors that other nodes have too."""

    def spread(batches):
        for b in batches:
            for rows, data, off in tx.slices(b, "text"):
                low = _anchors(data, length, gram)
                keys, nodes = [], []
                for node, a, z in zip(rows.column("node").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    if z - a >= length:
                        some = low[a:z - length + 1]
                        start, _ = _runs(some)
                        found = np.unique(some[start])
                        keys.append(found)
                        nodes.append(np.full(len(found), node, np.int64))
                if keys:
                    keys, nodes = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
                    for k in range(0, len(keys), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + (1 << 16)]), pa.array(nodes[k:k + (1 << 16)])], ["anchor", "node"])

    def several(batches):
        """Rows of anchors with more than one node; rows are sorted, a run may span batches."""
        held = None  # (anchor, node) of rows not yet known to be shared: one node so far
        for b in batches:
            key, node = b.column("anchor").to_numpy(), b.column("node").to_numpy()
            if not len(key):
                continue
            if held is not None:
                key, node = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], node])
            distinct = np.ones(len(key), bool)  # copies of a text give one node several times
            distinct[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[distinct], node[distinct]
            same = key[1:] == key[:-1]
            shared = np.zeros(len(key), bool)
            shared[1:] |= same
            shared[:-1] |= same
            if held is not None and held[2] and len(key) and key[0] == held[0]:
                shared[0] = False  # given out already
            known = bool(shared[-1]) or (held is not None and held[2] and len(key) == 1)
            held = (key[-1], node[-1], known)
            if shared.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[shared]), pa.array(key[shared])], ["node", "anchor"])

    flat = texts.select("node", "text").mapInArrow(spread, "anchor bigint, node bigint")
    flat = flat.repartition("anchor").sortWithinPartitions("anchor", "node")
    return flat.mapInArrow(several, "node bigint, anchor bigint").groupBy("node").agg(F.collect_list("anchor").alias("anchors"))


def _segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, bytes, places): segments of windows with a shared anchor, equal ones of a batch merged.

    Only the first document of each text is cut; choosing it here and not by a filter
    keeps the join below the same as that of the last step.
    """

    def cut(batches):
        for b in batches:
            for rows, data, off in tx.slices(b.filter(pc.equal(b.column("id"), b.column("rep"))), "text"):
                low = _anchors(data, length, gram)
                raw = data.tobytes()
                found: dict[bytes, list] = {}
                anchors: dict[bytes, int] = {}
                nodes, ids, wanted = rows.column("node").to_pylist(), rows.column("id").to_pylist(), rows.column("anchors")
                for k, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    if z - a < length:
                        continue
                    some = low[a:z - length + 1].view(np.int64)
                    start, end = _runs(some)
                    yes = np.isin(some[start], wanted[k].values.to_numpy())
                    for s, e, anchor in zip(start[yes].tolist(), end[yes].tolist(), some[start[yes]].tolist()):
                        piece = raw[a + s:a + e + length - 1]
                        found.setdefault(piece, []).append((nodes[k], ids[k], s))
                        anchors[piece] = anchor
                pieces = list(found)
                for at in range(0, len(pieces), 10_000):
                    part = pieces[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([anchors[p] for p in part], pa.int64()), pa.array(part, pa.binary()),
                        pa.array([np.array(found[p], _OCC).tobytes() for p in part], pa.binary())], ["anchor", "bytes", "places"])

    return texts.mapInArrow(cut, "anchor bigint, bytes binary, places binary")


class _Group:
    """Distinct segments of some anchors, and all their places."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.known: dict[bytes, int] = {}  # segment digest -> number
        self.lows = np.zeros(0, np.int64)  # smallest doc_id of each segment
        self.sizes: list[np.ndarray] = []
        self.pieces, self.places = [], []
        self.bytes = 0

    def add(self, pieces: list[bytes], places: list[bytes]) -> None:
        fresh, at, before = [], np.empty(len(pieces), np.int64), len(self.known)
        for i, piece in enumerate(pieces):
            at[i] = k = self.known.setdefault(_digest(piece), len(self.known))
            if k >= before + len(fresh):
                fresh.append(piece)
        seg = np.repeat(at, [len(o) // _OCC.itemsize for o in places])
        occ = np.frombuffer(b"".join(places), _OCC)
        if len(self.known) > len(self.lows):
            self.lows = np.append(self.lows, np.full(max(len(self.lows), len(self.known) - len(self.lows)), _LAST, np.int64))
        np.minimum.at(self.lows, seg, occ["id"])
        for k in range(0, len(seg), BLOCK):
            part = occ[k:k + BLOCK]
            self.places.append([self.scratch.keep(c.copy()) for c in (seg[k:k + BLOCK], part["node"], part["id"], part["at"])])
        if fresh:
            self.sizes.append(np.array([len(p) for p in fresh], np.int32))
            self.pieces.append(self.scratch.keep(np.frombuffer(b"".join(fresh), np.uint8)))
            self.bytes += int(self.sizes[-1].sum())

    def removed(self, length: int):
        yield from _removed(self.scratch, self.pieces, np.concatenate(self.sizes), self.lows[:len(self.known)], self.places, length)

    def windows(self, length: int):
        """What was added, as blocks of windows; the group is empty after it."""
        sizes, done, texts = np.concatenate(self.sizes), 0, []
        for kept, some in zip(self.pieces, self.sizes):
            raw = self.scratch.take(kept).tobytes()
            ends = np.cumsum(some).tolist()
            texts += [raw[z - n:z] for z, n in zip(ends, some.tolist())]
        del self.known
        for block in self.places:
            seg, node, ids, at = (self.scratch.take(c) for c in block)
            for a, z in _cuts(sizes[seg] - length + 1):
                own, of = np.unique(seg[a:z], return_inverse=True)
                yield _windows([texts[k] for k in own.tolist()], of, node[a:z], ids[a:z], at[a:z], length)


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _cuts(many: np.ndarray) -> list[tuple[int, int]]:
    """Cuts rows that make ``many`` windows each into parts of about a block of windows."""
    if not len(many):
        return []
    part = (np.cumsum(many, dtype=np.int64) - 1) // BLOCK
    at = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(many)]]).tolist()
    return list(zip(at, at[1:]))


def _windows(pieces: list[bytes], of: np.ndarray, node: np.ndarray, ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Every window of every place; place k holds the segment pieces[of[k]]."""
    many = np.array([len(p) - length + 1 for p in pieces], np.int64)
    digests = np.frombuffer(b"".join(_digest(p[k:k + length]) for p in pieces for k in range(len(p) - length + 1)), "<u8").reshape(-1, 2)
    first, n = (np.cumsum(many) - many)[of], many[of]
    row = np.repeat(np.arange(len(of)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    out = np.empty(len(row), _WINDOW)
    key = digests[first[row] + offset]
    out["a"], out["b"] = key[:, 0], key[:, 1]
    out["node"], out["id"], out["at"] = node[row], ids[row], at[row] + offset
    return out


class _Split:
    """Windows of a group beyond the bound, dealt by digits of their digest into parts within it."""

    def __init__(self, scratch: Scratch, most: int, level: int = 0):
        self.scratch, self.most, self.level = scratch, most, level
        self.parts: list[list] = [[] for _ in range(_FAN)]

    def add(self, block: np.ndarray) -> None:
        digit = (block["a"] // np.uint64(_FAN ** self.level)) % np.uint64(_FAN)
        block = block[np.argsort(digit, kind="stable")]
        ends = np.cumsum(np.bincount(digit.astype(np.int64), minlength=_FAN)).tolist()
        for part, a, z in zip(self.parts, [0, *ends], ends):
            if z > a:
                part.append(self.scratch.keep(block[a:z].copy()))

    def removed(self):
        for part in self.parts:
            low = np.zeros(0, _LOW)  # smallest doc_id of each window, by digest
            for k, kept in enumerate(part):
                block = self.scratch.take(kept)
                some = np.empty(len(block), _LOW)
                for c in _LOW.names:
                    some[c] = block[c]
                part[k] = self.scratch.keep(block)
                low = np.concatenate([low, some])
                low = low[np.lexsort((low["id"], low["b"], low["a"]))]
                low = low[_firsts(low)]
                if len(low) > self.most and self.level < _LEVELS:
                    break
            if len(low) > self.most and self.level < _LEVELS:
                del low
                deeper = _Split(self.scratch, self.most, self.level + 1)
                while part:
                    deeper.add(self.scratch.take(part.pop()))
                yield from deeper.removed()
                continue
            for kept in part:
                block = self.scratch.take(kept)
                both = np.empty(len(low) + len(block), _LOW)
                both[:len(low)] = low
                for c in _LOW.names:
                    both[c][len(low):] = block[c]
                order = np.lexsort((both["id"], both["b"], both["a"]))
                new = _firsts(both[order])
                least = np.empty(len(both), np.int64)
                least[order] = both["id"][order[np.flatnonzero(new)]][np.cumsum(new) - 1]
                gone = block[block["id"] > least[len(low):]]
                for k in range(0, len(gone), 1 << 16):
                    some = gone[k:k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(some["node"].copy()), pa.array(some["at"].copy()), pa.array(np.ones(len(some), np.int64))], ["node", "at", "many"])


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Whether a sorted row is the first of its digest."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
    return new


def _decide(length: int, memory: int):
    """Partition function: (anchor, bytes, places), by anchor -> (node, at, many): runs of removed windows."""
    bound, most = max(1 << 14, memory // _PER_BYTE), max(1 << 12, memory // 256)  # bytes of a group, windows of a part

    def run(batches):
        scratch = Scratch(memory)
        group, split, last = _Group(scratch), None, None
        try:
            for b in batches:
                anchors = b.column("anchor").to_numpy()
                pieces, places = b.column("bytes").to_pylist(), b.column("places").to_pylist()
                reach = np.cumsum([len(p) for p in pieces], dtype=np.int64)
                stops = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
                a = 0
                while a < len(anchors):
                    if anchors[a] != last and (split is not None or group.bytes >= bound):
                        yield from split.removed() if split is not None else group.removed(length)
                        scratch.close()
                        scratch = Scratch(memory)
                        group, split = _Group(scratch), None
                    z = max(a + 1, int(np.searchsorted(reach, reach[a] + bound, "right")))
                    if split is not None or group.bytes >= bound:  # only the anchor at hand
                        z = min(z, int(stops[np.searchsorted(stops, a, "right")]))
                    group.add(pieces[a:z], places[a:z])
                    if split is None and group.bytes >= 2 * bound:
                        split = _Split(scratch, most)
                    if split is not None:
                        for block in group.windows(length):
                            split.add(block)
                        group = _Group(scratch)
                    last, a = anchors[z - 1], z
            if split is not None:
                yield from split.removed()
            elif group.known:
                yield from group.removed(length)
        finally:
            scratch.close()

    return run


def _removed(scratch: Scratch, pieces: list, sizes: np.ndarray, lows: np.ndarray, places: list[list], length: int):
    starts = np.concatenate([[0], np.cumsum(sizes + 1, dtype=np.int64)])  # of each segment in the text, a separator behind each
    x = scratch.array(int(starts[-1]), np.uint16)
    keep = np.ones(len(x), bool)
    keep[starts[1:] - 1] = False
    flat = np.flatnonzero(keep)
    at = 0
    for p in pieces:
        block = scratch.take(p)
        x[flat[at:at + len(block)]] = block
        at += len(block)
    x[flat] += 1
    del flat, keep
    # at each position the smallest doc_id of its segment, and once its class of equal windows is closed, of the class
    low = scratch.array(len(x), np.int64)
    for k in range(0, len(sizes), 1 << 12):
        some = sizes[k:k + (1 << 12)]
        low[starts[k]:starts[k + len(some)]] = np.repeat(lows[k:k + len(some)], some + 1)
    open_pos: list[np.ndarray] = []  # the class that the last block left open

    def close(pos: np.ndarray, classes: np.ndarray) -> None:
        least = np.minimum.reduceat(low[pos], np.flatnonzero(np.diff(classes, prepend=-1)))
        low[pos] = least[classes]

    for pos, lcp in Suffixes(x, length, scratch).descending():
        same = lcp >= length
        if open_pos and same[0] and same.all():
            open_pos.append(pos)
            continue
        pos = np.concatenate([*open_pos, pos])
        same = np.concatenate([np.ones(len(pos) - len(same), bool), same])
        classes = np.cumsum(~same)
        classes -= classes[0]
        tail = int(np.searchsorted(classes, classes[-1]))
        if tail:
            close(pos[:tail], classes[:tail])
        open_pos = [pos[tail:]]
    if open_pos:
        done = np.concatenate(open_pos)
        close(done, np.zeros(len(done), np.int64))

    windows = sizes.astype(np.int64) - length + 1
    for block in places:
        seg, nodes, ids, first = (scratch.take(c) for c in block)
        whole = ids > lows[seg]
        out = [(nodes[whole], first[whole], windows[seg[whole]])]
        own = np.flatnonzero(~whole)  # the first document that has the segment: window by window
        for i, j in _cuts(windows[seg[own]]):
            some = own[i:j]
            many = windows[seg[some]]
            ends = np.cumsum(many)
            of = np.repeat(some, many)
            offset = np.arange(ends[-1]) - np.repeat(ends - many, many)
            gone = low[starts[seg[of]] + offset] < ids[of]
            begins, stops = gone.copy(), gone.copy()
            begins[1:] &= ~gone[:-1] | (of[1:] != of[:-1])
            stops[:-1] &= ~gone[1:] | (of[1:] != of[:-1])
            a, z = np.flatnonzero(begins), np.flatnonzero(stops)
            out.append((nodes[of[a]], first[of[a]] + offset[a], z - a + 1))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
        for k in range(0, len(cols[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[k:k + (1 << 16)]) for c in cols], ["node", "at", "many"])


def _intervals(at: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte intervals covered by windows at..at+many-1."""
    order = np.argsort(at, kind="stable")
    a, z = at[order], at[order] + many[order] + length - 1
    reach = np.maximum.accumulate(z)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return a[first], reach[np.append(first[1:], len(a)) - 1]


def _nodes(base: DataFrame, ident) -> tuple[DataFrame, DataFrame]:
    """``base`` with ``node``, a number for each distinct text, and (node, rep): the first document of each.

    Numbers are 64-bit hashes of the text's sha256; the aggregate that finds the first documents also finds
    numbers of two different texts, and then all are numbered anew with another seed.
    """
    seed = 0
    while True:
        numbered = base.withColumn("node", F.xxhash64(F.lit(seed), F.sha2("text", 256)))
        sha = F.unhex(F.sha2("text", 256))
        one = numbered.groupBy("node").agg(F.min(ident).alias("rep"), F.min(sha).alias("lo"), F.max(sha).alias("hi"))
        reps = written(one.select("node", "rep", (F.col("lo") != F.col("hi")).alias("clash")), "reps")
        if reps.where("clash").isEmpty():
            return numbered, reps.drop("clash")
        seed += 1


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", memory: int = 256 << 20, with_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row; kept are the remaining bytes."""
    gram = min(GRAM, length)
    kind = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ident = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST))
    base, reps = _nodes(base, ident)
    shared = _shared(base, length, gram)

    # both joins take the same columns of the texts, so one shuffle of them serves both
    first = base.join(reps.join(shared, "node"), "node").withColumn("id", ident)
    segments = _segments(first.select("node", "id", "rep", "doc_id", "text", "anchors"), length, gram)
    removed = segments.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_decide(length, memory), "node bigint, at bigint, many bigint")
    removed = removed.groupBy("node").agg(F.collect_list(F.struct("at", "many")).alias("gone"))
    joined = base.join(reps.join(removed, "node", "left"), "node").withColumn("id", ident).select("doc_id", "text", "id", "rep", "gone")
    out = [("n_bytes", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("n_spans", "bigint", pa.int64()), ("kept_sha256", "string", pa.string())]
    out += [("kept", "binary", pa.binary())] if with_bytes else []

    def apply(batches):
        for b in batches:
            rows = []
            for t, i, rep, gone in zip(b.column("text"), b.column("id").to_pylist(), b.column("rep").to_pylist(), b.column("gone")):
                raw = t.as_py().encode()
                kept, spans = raw, 0
                if i != rep and len(raw) >= length:
                    kept, spans = b"", 1
                elif i == rep and gone.is_valid:
                    a, z = _intervals(gone.values.field("at").to_numpy(), gone.values.field("many").to_numpy(), length)
                    edges = np.concatenate([[0], np.column_stack([a, z]).ravel(), [len(raw)]]).tolist()
                    kept, spans = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])), len(a)
                rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)[:len(out)])
            cols = list(zip(*rows)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, (_, _, t) in zip(cols, out))], ["doc_id", *(n for n, _, _ in out)])

    return joined.mapInArrow(apply, f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k, _ in out))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
