"""N-gram Jaccard self-join by prefix tree.

A document's set holds the distinct ``n``-word shingles of its whole text
(A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; with fewer words the whole
sequence is one shingle).  Documents link when
100 * intersection >= percent * union, in whole numbers.

Steps, each a Spark job over all documents:

1. ``shingle_classes``: how common each of 2**22 hash buckets of shingles is,
   counted over the whole corpus (4 MB whatever the corpus size).  A
   shingle's key is (class, hash), so sorting by key is one global order,
   rare shingles first.
2. ``signatures``: size, 128-bit set hash and prefix keys of every document.  Equal
   sets are one vertex from here on, however many documents have them.
3. The prefix of a set x has |x| - ceil(p|x|) + k keys, k = 1 + |x|/20.  Sets that
   link share at least min(k) keys of their prefixes, so a set with fewer keys
   that any other prefix has links with nothing, and linked sets are in one
   connected component of "shares a prefix key" (``_coarse``).
4. Only the sets left are built whole and dealt by that component.  Rows of a
   group come sorted by their keys and stream into the task, which holds one group
   of at most ``group_bytes`` (keys, and 512 bytes a set) at a time.
5. In a group the ordered sets form a trie (``Trie``).  A set's traversal walks
   it once for all sets that still may link, shares the overlap counted on
   common paths and leaves a subtree when the overlap so far and what
   remains of both cannot reach the bound.  Sets already in the component
   being built are skipped, so a group of thousands of near copies takes one
   traversal, not one for each pair; only (set, first set) links leave.
6. A component beyond ``group_bytes`` (``_large``) is first thinned: its sets are dealt by a
   minimum hash, so near copies meet, in groups of the same bound, and then a few sets of every cluster found
   meet each other.  What is left for the exact pass are the sets that share enough prefix keys with sets of *another* cluster;
   these are dealt as pairs of blocks, each within the bound, so no link is lost.
7. Components over the links, and the smallest doc_id of each.

A shingle's key has 58 bits of its hash; two different shingles of one pair of
documents are taken for one with a probability of about 3e-12 for sets of a thousand.

Defined cases: null or empty texts, or texts without words, have an empty set and
link with nothing.  Every row is a vertex of its own: repeated doc_ids with
different texts do not merge; a null doc_id is ignored when the smallest
doc_id is taken (a component of nulls only has a null id).  Very long texts are
sets like all others; one set larger than ``group_bytes`` is a block of its own.  Empty tables give an
empty result.  Columns of other names do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import text as tx
from basketry.llm.store import components, written

SKETCH_BITS = 22
_HASH_BITS = 58
_COUNT_BLOCK = 1 << 13
#: Bytes of text shingled at a time: the word and window arrays of a slice take some 50 bytes for each of them.
_SHINGLE_BYTES = 512 << 10


def _doc_shingles(batches: Iterator[pa.RecordBatch], n: int, text: str):
    """(rows, shingle hashes, first shingle of each row) of slices; hashes are in text order, with repeats."""
    for b in batches:
        for rows, data, off in tx.slices(b, text, _SHINGLE_BYTES):
            data = tx.lower(data)
            starts, ends, firsts = tx.word_spans(data, off, tx.SPACED)
            words = tx.word_hashes(data, starts, ends)
            grams = tx.window_hashes(words, n)
            keep = tx.inside_rows(firsts, n, len(words))
            at = np.flatnonzero(keep)
            counts = np.diff(firsts)
            short = np.flatnonzero((counts > 0) & (counts < n))
            hashes = grams[at]
            if len(short):  # the whole sequence as one shingle
                extra = np.array([int(tx.window_hashes(words[firsts[r]:firsts[r + 1]], int(counts[r]))[0]) for r in short], np.uint64)
                at = np.concatenate([at, firsts[short]])
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], np.concatenate([hashes, extra])[order]
            yield rows, hashes, np.searchsorted(at, firsts)


def shingle_classes(docs: DataFrame, n: int = 4, text: str = "text") -> np.ndarray:
    """For each hash bucket the bit length of its count over the corpus: 2**22 bytes, summed on the executors as a stream."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, hashes, _ in _doc_shingles(batches, n, text):
            total += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        for k in range(0, len(total), _COUNT_BLOCK):
            some = total[k:k + _COUNT_BLOCK]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _COUNT_BLOCK]), pa.array([some.astype(np.uint16 if some.max() < 1 << 16 else np.uint32).tobytes()])], ["part", "counts"])

    def add(batches):
        """Sums the rows of one bucket block after another; rows come sorted by block."""
        current, total = None, None
        for b in batches:
            for part, x in zip(b.column("part").to_pylist(), b.column("counts")):
                if part != current:
                    if current is not None:
                        yield _bits(current, total)
                    current, total = part, np.zeros(_COUNT_BLOCK, np.int64)
                raw = x.as_buffer()
                total += np.frombuffer(raw, np.uint16 if raw.size == 2 * _COUNT_BLOCK else np.uint32)
        if current is not None:
            yield _bits(current, total)

    counted = docs.select(text).mapInArrow(count, "part bigint, counts binary")
    summed = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part bigint, bits binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in summed.toLocalIterator():  # 512 rows of 8 KB whatever the corpus size
        out[r.part * _COUNT_BLOCK:(r.part + 1) * _COUNT_BLOCK] = np.frombuffer(r.bits, np.uint8)
    return out


def _bits(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.ceil(np.log2(total + 1.0)).astype(np.uint8).tobytes()])], ["part", "bits"])


def _keys(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted distinct (class, hash) keys of one document."""
    common = classes[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.unique((common << np.uint64(_HASH_BITS)) | (hashes & np.uint64((1 << _HASH_BITS) - 1)))


def _least(size: int, percent: int) -> int:
    """The smallest overlap of a set of this size with any set that it links with."""
    return -(-percent * size // 100)


def _extra(size: int) -> int:
    return 1 + size // 20


def _set_hash(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, classes, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, size, node, sig, prefix) of every row; sig is the 128-bit set hash (null for an empty set), node 64 bits of it."""

    def sign(batches):
        table = classes.value
        for rows, hashes, firsts in _doc_shingles(batches, n, "text"):
            size, node, sig, prefix = [], [], [], []
            for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
                keys = _keys(hashes[a:z], table)
                m = len(keys)
                size.append(m)
                sig.append(_set_hash(keys) if m else None)
                node.append(int.from_bytes(sig[-1][:8], "little", signed=True) if m else None)
                prefix.append(keys[:m - _least(m, percent) + _extra(m)].tobytes() if m else None)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "text_hash", "size", "node", "sig", "prefix"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return _hashed(docs, doc_id, text).mapInArrow(sign, f"doc_id {kind}, text_hash bigint, size bigint, node bigint, sig binary, prefix binary")


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))


def _prefix_rows(sets: DataFrame) -> DataFrame:
    """(key, node, size): the prefix keys of ``sets``, one row each."""

    def spread(batches):
        for b in batches:
            prefixes, node, sizes = b.column("prefix"), b.column("node").to_numpy(), b.column("size").to_numpy()
            keys = [np.frombuffer(p.as_buffer(), np.int64) for p in prefixes]
            if not keys:
                continue
            counts = np.array([len(k) for k in keys])
            flat, nodes, sizes = np.concatenate(keys), np.repeat(node, counts), np.repeat(sizes.astype(np.int32), counts)
            for k in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[k:k + (1 << 16)]) for x in (flat, nodes, sizes)], ["key", "node", "size"])

    return sets.select("node", "size", "prefix").mapInArrow(spread, "key bigint, node bigint, size int")


def _fewest(percent: int):
    """The fewest prefix keys that a set of ``size`` shares with any set it links with: that of the smallest partner."""
    return F.expr(f"1 + cast(({percent} * size + 99) div 100 as int) div 20")


def _coarse(sets: DataFrame, percent: int) -> DataFrame:
    """(node, part): distinct sets that share enough prefix keys with others, by component of "shares a prefix key".

    Prefix rows are (key, node) with node a 64-bit part of the set hash;
    sorted by key inside partitions, so runs of one key stream past and only
    rows of a key that several sets have go on.
    """

    def runs(batches):
        """Rows of keys with two nodes or more, with the first node of the key; a run may span batches."""
        held = None  # the last key's first row, not yet given out; or its key and first node once given
        last_key = last_root = None
        for b in batches:
            key, node, size = (b.column(c).to_numpy() for c in ("key", "node", "size"))
            if not len(key):
                continue
            if held is not None:
                key, node, size = (np.concatenate([[h], x]) for h, x in zip(held, (key, node, size)))
                held = None
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            length = np.diff(np.append(at, len(key)))
            root = node[at]
            known = last_key is not None and key[0] == last_key
            if known:
                root[0] = last_root
            keep = length[run] > 1
            if known:
                keep[:at[1] if len(at) > 1 else len(key)] = True
            if length[-1] == 1 and not (known and len(at) == 1):
                held = (key[-1], node[-1], size[-1])
                last_key = None
            else:
                last_key, last_root = key[-1], root[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(size[keep].astype(np.int32)), pa.array(root[run][keep])], ["node", "size", "root"])

    flat = _prefix_rows(sets).repartition("key").sortWithinPartitions("key", "node")
    shared = written(flat.mapInArrow(runs, "node bigint, size int, root bigint"), "shared")
    live = shared.groupBy("node", "size").count().where(F.col("count") >= _fewest(percent)).select("node")
    parts = components(shared.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "coarse")
    return parts.join(live, "node", "left_semi").select("node", F.col("root").alias("part"))


class Trie:
    """Radix tree over ordered sets: node i covers the sorted sets lo[i]..hi[i]-1 and the keys start[i]..end[i]-1 on its edge."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.children: list[list[int]] = []
        self.lo, self.hi, self.start, self.end = [], [], [], []
        self.size = np.array([len(s) for s in sets])
        if sets:
            shared = [0] + [self._common(a, b) for a, b in zip(sets, sets[1:])]
            self._build(np.array(shared + [0]))

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def _node(self, lo: int, hi: int, start: int, end: int) -> int:
        self.children.append([])
        self.lo.append(lo)
        self.hi.append(hi)
        self.start.append(start)
        self.end.append(end)
        return len(self.lo) - 1

    def _build(self, shared: np.ndarray) -> None:
        self._node(0, len(self.sets), 0, 0)
        todo = [0]
        while todo:
            i = todo.pop()
            lo, hi, depth = self.lo[i], self.hi[i], self.end[i]
            cuts = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1:hi] <= depth)).tolist(), hi]
            for a, z in zip(cuts, cuts[1:]):
                deep = len(self.sets[a]) if z - a == 1 else int(shared[a + 1:z].min())
                if z - a == 1 and deep == depth:
                    continue  # a set that ends at this node
                j = self._node(a, z, depth, deep)
                self.children[i].append(j)
                if z - a > 1:
                    todo.append(j)
        self.firsts = [np.array([self.lo[j] for j in below]) for below in self.children]

    def linked(self, x: np.ndarray, wanted: np.ndarray, percent: int) -> list[int]:
        """Positions among ``wanted`` (ascending) whose sets link with x: one walk, overlaps shared along common paths."""
        found: list[int] = []
        m = len(x)
        stack = [(0, wanted, 0)]
        while stack:
            i, some, overlap = stack.pop()
            sizes = self.size[some]
            edge = self.sets[self.lo[i]][self.start[i]:self.end[i]]
            used = 0  # keys of x that come before what is left of the edge's sets
            if len(edge):
                at = np.searchsorted(x, edge)
                overlap += int((x[np.minimum(at, m - 1)] == edge).sum())
            depth = self.end[i]
            if depth:
                used = int(np.searchsorted(x, self.sets[self.lo[i]][depth - 1], "right"))
            best = overlap + np.minimum(m - used, sizes - depth)
            may = 100 * best >= percent * (m + sizes - best)
            some, sizes = some[may], sizes[may]
            ends = sizes == depth
            if ends.any():
                found += some[ends].tolist()
                some = some[~ends]
            if not len(some):
                continue
            below, starts = self.children[i], self.firsts[i]
            of = np.searchsorted(starts, some, "right") - 1
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, z in zip(cuts, cuts[1:]):
                stack.append((below[of[a]], some[a:z], overlap))
        return found


def _links(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set (distinct, lexicographically sorted) the position of the first set found of its component."""
    trie = Trie(sets)
    prefix = [s[:len(s) - _least(len(s), percent) + _extra(len(s))] for s in sets]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(p) for p in prefix])
    flat = np.concatenate(prefix)
    order = np.argsort(flat, kind="stable").astype(np.int32 if len(flat) < 1 << 31 else np.int64)
    flat, owner = flat[order], owner[order]
    del order
    root = [-1] * len(sets)
    done = np.zeros(len(sets), bool)
    for s in range(len(sets)):
        if root[s] >= 0:
            continue
        root[s] = s
        done[s] = True
        todo = [s]
        while todo:
            x = todo.pop()
            a, z = np.searchsorted(flat, prefix[x]), np.searchsorted(flat, prefix[x], "right")
            near = np.concatenate([owner[i:j] for i, j in zip(a.tolist(), z.tolist())])
            near = near[~done[near]]
            if not len(near):
                continue
            near, shares = np.unique(near, return_counts=True)
            near = near[shares >= np.minimum(_extra(len(sets[x])), 1 + trie.size[near] // 20)]
            for y in trie.linked(sets[x], near, percent) if len(near) else ():
                root[y] = s
                done[y] = True
                todo.append(y)
    return root


#: A task needs less than twice this for a group, so two tasks at the bound fit beside a heap of 1,800 MB in 3,000.
GROUP_BYTES = 192 << 20
_SET_BYTES = 512  # what a set costs in a task besides its keys
_HUBS = 4  # sets of a cluster that stand for it


def _group_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the sets (grp, sig, keys) inside each group; keys are big-endian, so their byte order is the trie's order.

    Groups stream past, sorted; a task holds the keys of one group, copied once out of the Arrow batches.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sigs, sets = None, [], []

        def found():
            if len(sets) < 2:
                return
            roots = _links(sets, percent)
            pairs = [(sigs[i], sigs[r]) for i, r in enumerate(roots) if r != i]
            for k in range(0, len(pairs), 1 << 16):
                a, b = zip(*pairs[k:k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for b in batches:
            for g, sig, keys in zip(b.column("grp").to_pylist(), b.column("sig").to_pylist(), b.column("keys")):
                if g != current:
                    yield from found()
                    current, sigs, sets = g, [], []
                if not sigs or sigs[-1] != sig:  # copies of a set are neighbours
                    sigs.append(sig)
                    sets.append(np.frombuffer(keys.as_buffer(), ">u8").astype(np.uint64))
        yield from found()

    return rows.repartition("grp").sortWithinPartitions("grp", "keys").mapInArrow(walk, "a binary, b binary")


def _blocks(weight: str, most: int):
    return F.expr(f"cast(ceil({weight} / {most}) as int)")


def _paired(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(grp, sig, keys): every set of a part with every block of the part; ``blocks`` is (part, blocks)."""
    own = F.expr("cast(pmod(xxhash64(sig), blocks) as int)")
    dealt = rows.join(blocks, "part").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.select(F.xxhash64("part", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "sig", "keys")


def _large(built: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): links of all sets (sig, part, weight, large, least, keys); parts beyond ``most`` bytes are ``large``."""
    rows = built.where("large")
    buckets = rows.groupBy("part", "least").agg(F.sum("weight").alias("total")).select("part", "least", _blocks("total", most).alias("blocks"))
    near = built.join(buckets, ["part", "least"], "left")
    near = near.select(F.expr("if(large, xxhash64(part, least, pmod(xxhash64(sig), blocks)), part)").alias("grp"), "sig", "keys")
    links = written(_group_links(near, percent), "near")

    def clusters(name: str) -> DataFrame:
        of = components(links, name)
        names = rows.select("sig", "part").distinct()
        return names.join(of.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "part", F.coalesce("root", "sig").alias("cluster"))

    # a few sets of every cluster of two or more meet, as do the clusters they stand for
    hubs = clusters("near").groupBy("part", "cluster").agg(F.count(F.lit(1)).alias("many"), *[F.min(F.struct(F.xxhash64("sig", F.lit(k)), "sig"))["sig"].alias(f"s{k}") for k in range(_HUBS)]).where("many > 1")
    hubs = hubs.select(F.explode(F.array_distinct(F.array(*[f"s{k}" for k in range(_HUBS)]))).alias("sig"))
    hubs = written(rows.join(hubs, "sig", "left_semi"), "hubs")
    totals = hubs.groupBy("part").agg(F.sum("weight").alias("total")).select("part", _blocks("total", most).alias("blocks"))
    met = hubs.join(totals, "part").select(F.expr("xxhash64(part, pmod(xxhash64(least), blocks))").alias("grp"), "sig", "keys")
    links = written(links.unionAll(_group_links(met, percent)), "met")

    # exact: sets with enough prefix keys that sets of another cluster have too
    of = written(clusters("met").join(sets.select("sig", "node", "size"), "sig"), "clusters")
    prefixes = written(_prefix_rows(sets.join(of.select("sig"), "sig", "left_semi")).join(of.select("node", "cluster"), "node"), "prefixes")
    shared = prefixes.groupBy("key").agg(F.min("cluster").alias("one"), F.max("cluster").alias("two")).where("one <> two").select("key")
    live = prefixes.join(shared, "key", "left_semi").groupBy("node", "size").count().where(F.col("count") >= _fewest(percent)).select("node")
    left = written(rows.join(of.join(live, "node", "left_semi").select("sig"), "sig", "left_semi"), "left")
    totals = left.groupBy("part").agg(F.sum("weight").alias("total"))
    totals = totals.select("part", F.when(F.col("total") <= most, 1).otherwise(_blocks("total", most // 2)).alias("blocks"))
    return links.unionAll(_group_links(_paired(left, totals), percent))


def link_components(docs: DataFrame, n: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    classes = sc.broadcast(shingle_classes(docs.select(text), n, text))
    signed = written(signatures(docs, classes, n, percent, doc_id, text), "signatures")
    sets = signed.where("sig is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "text_hash", "node", "size", "prefix")).alias("r")).select("sig", "r.*")
    coarse = written(_coarse(sets, percent), "coarse")

    # whole sets of the documents that may link; one document for each distinct set
    weight = F.expr(f"8 * size + {_SET_BYTES}")
    live = sets.select("sig", "node", F.col("doc_id").alias("rep"), F.col("text_hash").alias("rep_hash"), weight.alias("weight")).join(coarse, "node")
    totals = written(live.groupBy("part").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("many")).where("many > 1"), "parts")
    wanted = live.join(totals.select("part", (F.col("total") > group_bytes).alias("large")), "part").select("rep", "rep_hash", "sig", "part", "weight", "large")
    texts = _hashed(docs, doc_id, text)
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("text", "sig", "part", "weight", "large")

    def whole(batches):
        table = classes.value
        seen: set[bytes] = set()  # repeated rows give their set once in a task
        for rows, hashes, firsts in _doc_shingles(batches, n, "text"):
            ok, least, built = [], [], []
            for k, (s, a, z) in enumerate(zip(rows.column("sig").to_pylist(), firsts[:-1].tolist(), firsts[1:].tolist())):
                if s in seen:
                    continue
                keys = _keys(hashes[a:z], table)
                if len(keys) and _set_hash(keys) == s:
                    if len(seen) < 1 << 16:
                        seen.add(s)
                    ok.append(k)
                    least.append(int(tx.mix(keys * np.uint64(tx.splitmix(31))).min() >> np.uint64(1)))
                    built.append(keys.astype(">u8").tobytes())
            some = rows.take(pa.array(ok, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("sig", "part", "weight", "large")), pa.array(least, pa.int64()), pa.array(built, pa.binary())], ["sig", "part", "weight", "large", "least", "keys"])

    built = joined.mapInArrow(whole, "sig binary, part bigint, weight bigint, large boolean, least bigint, keys binary")
    if totals.where(F.col("total") > group_bytes).isEmpty():
        links = _group_links(built.select(F.col("part").alias("grp"), "sig", "keys"), percent)
    else:
        links = _large(written(built, "built"), sets, percent, group_bytes)
    roots = written(components(links, "links"), "roots")
    of = signed.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "size", F.coalesce("root", "sig").alias("root"))
    low = of.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("low"))
    out = of.join(low, "root", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are the first of their group of linked documents, with their own columns.

    First is the smallest (doc_id, text hash), null doc_ids before all others; repeated equal rows stay together.
    """
    key = lambda: F.struct(docs["doc_id"].alias("doc_id"), F.xxhash64(docs[text]).alias("text"))
    found = link_components(docs.select(key().alias("doc_id"), docs[text].alias("text")), n, percent)
    lost = found.where("doc_id <> component_id").select(F.col("doc_id").alias("lost")).distinct()
    return docs.join(lost, key() == lost["lost"], "left_anti")


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM words
),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * o >= 85 * (na + nb - o) UNION ALL SELECT b, a FROM shared WHERE 100 * o >= 85 * (na + nb - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id AS doc_id, len(s.s) AS n_shingles, r.component_id AS component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
"""


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
