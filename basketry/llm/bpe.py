"""Byte-level BPE encoding and decoding with tree concatenation of long unsplit text.

The vocabulary (a ``tokenizers`` JSON file) is read once on the driver and
broadcast; its size is fixed by the file.  A text is cut at the special token
and by the byte-level pattern; each piece is encoded by merging pairs in rank
order, and short pieces are kept in a bounded cache.

A piece that the pattern does not split can be arbitrarily long.  It is
encoded as a tree: halves down to ``LEAF`` bytes are encoded on their own and
neighbours are joined.  Around a join the last and first ``w`` tokens are
re-encoded, with ``w`` doubled until the first token of the window is the left
side's own token there and the last one the right side's (or the window has
reached the end of that side).  Then every neighbouring pair of the joined
sequence is a pair that the encoder leaves apart, so the sequence is the
encoding of the whole piece.

Documents that hold unsplit text of ``LONG`` characters or more are encoded by
rows of leaves dealt over all tasks, and joined by document; all others are
encoded where they are read, with no shuffle.

Defined cases: a null or empty text has no tokens and decodes to the empty text.
Repeated rows and null or repeated doc_ids give one row each.  Empty tables give
empty results.  Other columns do not take part; their names are free.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAF = 512
LONG = 4096
_CACHE = 300_000
_BITS = 24
_MASK, _NONE = (1 << _BITS) - 1, 1 << 62
#: The byte-level pattern and its white space (Unicode White_Space).
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


#: The same for texts of Latin letters only (below U+0250), with the letters and numbers of that range written out.
_LATIN_L, _LATIN_N, _LATIN_S = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_LATIN = rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN_L}]+| ?[{_LATIN_N}]+| ?[^{_LATIN_S}{_LATIN_L}{_LATIN_N}]+|[{_LATIN_S}]+(?![^{_LATIN_S}])|[{_LATIN_S}]+"
_BEYOND = re.compile("[\u0250-\U0010ffff]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code points from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """Token bytes -> id, merges in rank order, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    raw = lambda token: bytes(alphabet[c] for c in token)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return vocab, [(raw(a), raw(b)) for a, b in pairs], special


class Coder(dict):
    """Encoder and decoder of one vocabulary; as a dict, the cache of short pieces (text -> ids as bytes)."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int]):
        super().__init__()
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merges = {vocab[a] << _BITS | vocab[b]: (rank + 1) << _BITS | vocab[a + b] for rank, (a, b) in enumerate(merges)}
        self.special = special
        self.older: dict[str, bytes] = {}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        self.any, self.latin = regex.compile(_PATTERN), re.compile(_LATIN)

    def pattern(self, text: str):
        """The splitter for a text: the quicker one where all its characters are Latin."""
        return self.any if _BEYOND.search(text) else self.latin

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            out = np.array(self.piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= _CACHE:  # two generations: what is in use moves over, the rest goes
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one unsplit piece; a long one by halves."""
        if len(raw) <= LEAF:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.piece(raw[:half]), self.piece(raw[half:]))

    def merge(self, raw: bytes) -> list[int]:
        """Plain merging in rank order, leftmost first."""
        ids = [self.single[b] for b in raw]
        if len(ids) > 64:
            return self._merge_heap(ids)
        known = self.merges.get
        codes = [known(a << _BITS | b, _NONE) for a, b in zip(ids, ids[1:])]  # of each pair: rank and new id
        while codes:
            best = min(codes)
            if best == _NONE:
                break
            k = codes.index(best)
            ids[k:k + 2] = [best & _MASK]
            del codes[k]
            if k < len(codes):
                codes[k] = known(ids[k] << _BITS | ids[k + 1], _NONE)
            if k:
                codes[k - 1] = known(ids[k - 1] << _BITS | ids[k], _NONE)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank and new id, position), for windows and leaves."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = self.merges.get
        heap = [(m, k, ids[k], ids[k + 1]) for k in range(n - 1) if (m := known(ids[k] << _BITS | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            m, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            new = m & _MASK
            ids[k], ids[nxt] = new, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if m := known(new << _BITS | ids[after[k]]):
                    heapq.heappush(heap, (m, k, new, ids[after[k]]))
            if before[k] >= 0 and (m := known(ids[before[k]] << _BITS | new)):
                heapq.heappush(heap, (m, before[k], ids[before[k]], new))
        return [i for i in ids if i >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours of one unsplit piece."""
        if not left or not right:
            return left or right
        w = 1
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            window = self.merge(b"".join(self.bytes_of[i] for i in left[-a:] + right[:b]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:-a] + window + right[b:]
            w *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Neighbours joined pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def sections(self, text: str):
        """Runs of the text between special tokens, and those tokens."""
        return [p for p in self.cut.split(text) if p] if self.cut and any(s in text for s in self.special) else [text] if text else []

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.sections(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif len(part) < 1 << 20:
                out += map(self.__getitem__, self.pattern(part).findall(part))
            else:  # a list of all pieces of a very long text would be large
                found = (m.group() for m in self.pattern(part).finditer(part))
                while some := list(islice(found, 100_000)):
                    out.append(b"".join(map(self.__getitem__, some)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODERS: dict[int, Coder] = {}


def _coder(spec) -> Coder:
    """The worker's coder for a broadcast vocabulary."""
    key = spec.id if hasattr(spec, "id") else id(spec)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(*spec.value)
    return _CODERS[key]


def _result(coder: Coder, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids).encode()).hexdigest()


_OUT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_NAMES = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row; ids as little-endian unsigned 32-bit integers."""
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_vocabulary()))
    kind = docs.schema[doc_id].dataType.simpleString()
    more = ", ids binary" if with_ids else ""
    names = _NAMES if with_ids else _NAMES[:3]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    unsplit = f"length(text) >= {LONG} and text rlike '[^ \\\\t\\\\n\\\\r]{{{LONG},}}|[ \\\\t\\\\n\\\\r]{{{LONG},}}'"
    docs = docs.withColumn("unsplit", F.coalesce(F.expr(unsplit), F.lit(False)))

    def whole(batches):
        coder = _coder(spec)
        for b in batches:
            out = []
            for t in b.column("text"):
                ids = coder.encode(t.as_py() or "")
                out.append((*_result(coder, ids), ids))
            cols = list(zip(*out)) or [[]] * 4
            types = [pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols[:len(names)], types))], ["doc_id", *names])

    short = docs.where("not unsplit").select("doc_id", "text").mapInArrow(whole, f"doc_id {kind}, {_OUT}{more}")

    def leaves(batches):
        """Runs of split text as ids, unsplit text as leaves still to encode: (sha, section, leaf, ids, raw)."""
        coder = _coder(spec)
        for b in batches:
            for sha, t in zip(b.column("sha").to_pylist(), b.column("text")):
                rows, ready = [], []
                section = 0

                def close():
                    nonlocal section, ready
                    if ready:
                        rows.append((sha, section, 0, b"".join(ready), None))
                        section, ready = section + 1, []

                for part in coder.sections(t.as_py()):
                    if part in coder.special:
                        ready.append(np.array([coder.special[part]], "<u4").tobytes())
                        continue
                    for m in coder.pattern(part).finditer(part):
                        if m.end() - m.start() < LONG:
                            ready.append(coder[m.group()])
                            continue
                        close()
                        raw = m.group().encode()
                        rows += [(sha, section, k, None, raw[at:at + LONG]) for k, at in enumerate(range(0, len(raw), LONG))]
                        section += 1
                close()
                for k in range(0, len(rows), 1000):
                    cols = list(zip(*rows[k:k + 1000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["sha", "section", "leaf", "ids", "raw"])

    def encode_leaves(batches):
        coder = _coder(spec)
        for b in batches:
            ids = [i if i is not None else np.array(coder.piece(r), "<u4").tobytes() for i, r in zip(b.column("ids").to_pylist(), b.column("raw").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("sha"), b.column("section"), b.column("leaf"), pa.array(ids, pa.binary())], ["sha", "section", "leaf", "ids"])

    def join_document(pdf: pd.DataFrame) -> pd.DataFrame:
        coder = _coder(spec)
        pdf = pdf.sort_values(["section", "leaf"])
        out = [np.array(coder.join_all([np.frombuffer(i, "<u4").tolist() for i in some["ids"]]), "<u4").tobytes() if len(some) > 1 else some["ids"].iloc[0] for _, some in pdf.groupby("section", sort=True)]
        ids = b"".join(out)
        return pd.DataFrame([(pdf["sha"].iloc[0], *_result(coder, ids), ids)[:1 + len(names)]], columns=["sha", *names])

    long = docs.where("unsplit").withColumn("sha", F.sha2("text", 256))
    parts = long.groupBy("sha").agg(F.min("text").alias("text")).mapInArrow(leaves, "sha string, section bigint, leaf bigint, ids binary, raw binary")
    parts = parts.repartition("sha", "section", "leaf").mapInArrow(encode_leaves, "sha string, section bigint, leaf bigint, ids binary")
    joined = parts.groupBy("sha").applyInPandas(join_document, f"sha string, {_OUT}{more}")
    far = long.select("doc_id", "sha").join(joined, "sha").select("doc_id", *names)
    return short.unionAll(far)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids (null ids: the empty text)."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path or default_vocabulary()))

    def texts(batches):
        coder = _coder(spec)
        for b in batches:
            yield b.append_column("decoded", pa.array([coder.decode(i or b"") for i in b.column(ids).to_pylist()], pa.string()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(texts, f"{ddl}, decoded string")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    return encode(docs, doc_id, text, path, with_ids=False)


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
