"""External induced sorting against plain sorting, with and without disk."""

import random

import numpy as np
import pytest

from basketry.llm import suffix


@pytest.mark.parametrize("memory,block,alphabet", [(1 << 20, 1 << 19, 4096), (0, 3, 4096), (500, 1000, 4), (1 << 20, 3, 1)])
def test_order_and_common_prefixes(monkeypatch, memory, block, alphabet):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "SMALL_ALPHABET", alphabet)
    rng = random.Random(1)
    for t in range(60):
        chars = rng.choice([b"ab", b"a", b"abc", bytes(range(256)), b"etaoin "])
        strings = [bytes(rng.choice(chars) for _ in range(rng.choice([1, 2, 5, 20, 60]))) for _ in range(rng.randint(1, 8))]
        strings += [s + s for s in strings] if t % 3 == 0 else []
        x = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
        with suffix.Scratch(memory) as scratch:
            blocks = [(p.copy(), c.copy()) for p, c in suffix.Suffixes(x, 50, scratch).descending()]
        stops = np.flatnonzero(x == 0)
        part = lambda p: tuple(x[p:stops[np.searchsorted(stops, p)]].tolist())[:50]
        found = [part(p) for b, _ in blocks for p in b.tolist()]
        common = [int(c) for _, b in blocks for c in b]
        assert found == sorted((part(p) for p in range(len(x)) if x[p]), reverse=True)
        for a, b, c in zip(found, found[1:], common[1:]):
            assert c == next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))


def test_files_go(tmp_path, monkeypatch):
    monkeypatch.setenv("TMPDIR", str(tmp_path))
    monkeypatch.setattr(suffix.tempfile, "tempdir", None)
    with pytest.raises(RuntimeError):
        with suffix.Scratch(0) as scratch:
            scratch.keep(np.arange(10))
            assert list(tmp_path.iterdir())
            raise RuntimeError
    assert not list(tmp_path.iterdir())
