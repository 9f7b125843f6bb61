"""A shard of the suffix-array dedup far larger than its memory: many anchors, and one anchor with everything."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import repeats


def shard(rng, groups, each, size, ids):
    """Batches of (anchor, bytes, places) by anchor; segments of one anchor share windows."""
    rows, node = [], 0
    for anchor in range(groups):
        shared = bytes(rng.choices(b"etaoin shrdlu", k=60))
        for _ in range(each):
            piece = bytes(rng.choices(b"etaoin shrdlu", k=rng.randint(0, size))) + shared[rng.randint(0, 20):]
            piece = piece if len(piece) >= 50 else shared
            occ = [(node + k, rng.randrange(ids), rng.randrange(1000)) for k in range(rng.randint(1, 3))]
            node += len(occ)
            rows.append((anchor, piece, np.array(occ, repeats._OCC).tobytes()))
    return [pa.RecordBatch.from_pylist([dict(zip(("anchor", "bytes", "places"), r)) for r in rows[k:k + 700]]) for k in range(0, len(rows), 700)]


def want(batches, length=50):
    first, out = {}, Counter()
    rows = [(r["bytes"], occ) for b in batches for r in b.to_pylist() for occ in np.frombuffer(r["places"], repeats._OCC).tolist()]
    for piece, (_, i, _) in rows:
        for k in range(len(piece) - length + 1):
            first[piece[k:k + length]] = min(first.get(piece[k:k + length], i), i)
    for piece, (node, i, at) in rows:
        out.update((node, at + k) for k in range(len(piece) - length + 1) if first[piece[k:k + length]] < i)
    return out


def found(batches, memory):
    out = Counter()
    for b in repeats._decide(50, memory)(iter(batches)):
        for r in b.to_pylist():
            out.update((r["node"], r["at"] + k) for k in range(r["many"]))
    return out


@pytest.mark.parametrize("memory", [1 << 20, 256 << 20])
@pytest.mark.parametrize("groups,each", [(400, 5), (1, 1500)])
def test_shard_in_groups(groups, each, memory):
    batches = shard(random.Random(3), groups, each, 60, 500)
    assert want(batches) == found(batches, memory)


@pytest.mark.parametrize("groups,each", [(1500, 10), (1, 15_000)])
def test_memory_does_not_follow_the_shard(groups, each):
    """A shard of 2 MB with a budget of 8 MB, of which a group may have a 64th."""
    batches = shard(random.Random(4), groups, each, 120, 1 << 40)
    tracemalloc.start()
    try:
        n = sum(len(b) for b in repeats._decide(50, 8 << 20)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n and peak < 48 << 20
