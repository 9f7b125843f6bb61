"""Merkle dataset manifest: a persistent tree of fan-out 8 for each group, built and versioned in aligned blocks.

A leaf is the sha256 of a row's columns, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value.  Inside a group (``lang``) the leaves ascend by
``doc_id``; every 8 consecutive nodes become their hash until one is left, the
group's subroot; the subroots, ordered by group (null first), give the root in
the same way.  Digests are joined as lowercase hex.

How the work is dealt:

1. Leaves are hashed in the scan; texts go no further.  ``keyed_row_number``
   gives each leaf its position in its group by a sampled range sort, so a
   group with most of all rows spans many tasks (repeated rows too: the last
   sort column tells them apart).
2. An aligned block of 8**4 leaves becomes one node four levels up, a block of
   8**4 such nodes the next, until every group is one node: each round is one
   group-by of bounded groups, and writes all nodes it makes (``nodes``).
3. Downwards, each block gets the siblings on the path from its node to the root
   from the block above it.
4. A block's tree is persistent (``Tree``): a changed leaf makes a ``Version``
   that copies the leaf's ancestors in the block and shares every other node with
   the original.  The version goes on above the block along that path, with one
   new node for each level, so a thousand tampered leaves are a thousand short lists of
   copies and never a thousand trees.

Memory of a task: one block, 4,096 digests and their siblings.  To the driver
comes one number for each round (the largest group).

Defined cases: a null doc_id is ordered first and is never tampered with;
rows of the same doc_id are ordered by their leaf, and equal rows have equal leaves
at neighbouring positions, each with its own proof.  Empty and very long texts are
hashed whole.  A table without rows has no tree and gives an empty result.
Other columns do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.store import written
from basketry.operators.rownum import keyed_row_number

FANOUT = 8
DEPTH = 4
BLOCK = FANOUT**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def H(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    """The leaf of a row: null values ``-``, others their UTF-8 byte count, ``:``, value."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def levels(n: int) -> int:
    """Levels between ``n`` nodes and the one above them all."""
    up = 0
    while FANOUT**up < n:
        up += 1
    return up


class Tree:
    """The tree of one aligned block: ``layers[0]`` its own nodes, ``layers[-1]`` the one above them."""

    def __init__(self, digests: list[str], up: int):
        self.layers = [digests]
        for _ in range(up):
            below = self.layers[-1]
            self.layers.append([H(*below[k:k + FANOUT]) for k in range(0, len(below), FANOUT)])
        self._siblings: dict[tuple[int, int], tuple[str, str]] = {}

    def siblings(self, level: int, at: int) -> tuple[str, str]:
        """The digests left and right of a node in its run, each joined."""
        got = self._siblings.get((level, at))
        if got is None:
            layer, first = self.layers[level], at - at % FANOUT
            got = self._siblings[level, at] = ("".join(layer[first:at]), "".join(layer[at + 1:first + FANOUT]))
        return got

    def path(self, at: int) -> list[tuple[str, str]]:
        return [self.siblings(k, at // FANOUT**k) for k in range(len(self.layers) - 1)]


class Version:
    """A tree with one leaf replaced: the copied path from that leaf up, all other nodes shared with ``tree``."""

    def __init__(self, tree: Tree, at: int, digest: str):
        self.tree, self.at = tree, at
        self.copies = [digest]
        for left, right in tree.path(at):
            self.copies.append(H(left, self.copies[-1], right))

    def node(self, level: int, at: int) -> str:
        return self.copies[level] if at == self.at // FANOUT**level else self.tree.layers[level][at]

    @property
    def top(self) -> str:
        return self.copies[-1]


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The digest at the end of a path of siblings."""
    for left, right in path:
        digest = H(left, digest, right)
    return digest


def _up(n: int) -> int:
    return min(DEPTH, levels(n))


def _raise(nodes: DataFrame, name: str) -> DataFrame:
    """All nodes made above ``nodes`` (g, pos, hash, n) by one round: (g, level, pos, hash, n, top).

    Rows with ``top`` are the next round's nodes, n of them in their group.
    """

    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n, first = block["n"][0].as_py(), block["pos"][0].as_py()
        tree = Tree(block["hash"].to_pylist(), _up(n))
        out = [(k, first // FANOUT**k + i, digest) for k, layer in enumerate(tree.layers) for i, digest in enumerate(layer) if k or len(tree.layers) == 1]
        level, pos, digest = zip(*out)
        m, up = len(out), len(tree.layers) - 1
        left = -(-n // FANOUT**up)
        return pa.table({"g": pa.array([block["g"][0].as_py()] * m, pa.string()), "level": pa.array(level, pa.int32()), "pos": pa.array(pos, pa.int64()),
                         "hash": pa.array(digest, pa.string()), "n": pa.array([left] * m, pa.int64()), "top": pa.array([k == up for k in level], pa.bool_())})

    dealt = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return written(dealt.groupBy("g", "block").applyInArrow(build, "g string, level int, pos bigint, hash string, n bigint, top boolean"), name)


@dataclass
class Manifest:
    """``leaves``: (g, pos, n, leaf and what else the caller gave); ``rounds``: the nodes each round started from;
    ``nodes``: every node above the leaves; ``subroots``: (g, pos, hash, n) in group order."""

    leaves: DataFrame
    rounds: list[DataFrame]
    nodes: list[DataFrame]
    subroots: DataFrame


def _rounds(nodes: DataFrame, name: str) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(nodes each round started from, nodes made, the single nodes of all groups)."""
    starts, made, single = [], [], None
    while True:
        starts.append(nodes)
        out = _raise(nodes, f"{name}-{len(starts)}")
        made.append(out)
        tops = out.where("top").select("g", "pos", "hash", "n")
        done = tops.where("n = 1")
        single = done if single is None else single.unionAll(done)
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            return starts, made, single


def build(leaves: DataFrame, group: str, order: list[str], name: str = "merkle") -> Manifest:
    """The manifest of ``leaves``, which has the column ``leaf`` (hex); in a group they ascend by ``order``, then leaf."""
    leaves = written(leaves, f"{name}-hashed")  # the range sort samples its input: texts are read and hashed once
    keyed = leaves.withColumn("g", F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group))))
    keyed = keyed.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    numbered = keyed_row_number(keyed, ["g"], [*((c, False) for c in order), ("leaf", False), ("spread", False)], "pos")
    numbered = numbered.withColumn("pos", F.col("pos") - 1)
    counts = numbered.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    placed = written(numbered.join(counts, "g").drop("spread"), f"{name}-leaves")
    starts, made, single = _rounds(placed.select("g", "pos", F.col("leaf").alias("hash"), "n"), name)
    ordered = keyed_row_number(single.select(F.col("g").alias("of"), "hash", F.lit("").alias("g")), ["g"], [("of", False)], "pos")
    ordered = ordered.withColumn("pos", F.col("pos") - 1)
    total = ordered.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return Manifest(placed, starts, made, written(ordered.join(total, "g"), f"{name}-subroots"))


_PATH = "array<struct<left: string, right: string>>"


def _below(nodes: DataFrame, above: DataFrame | None, out: Callable[[pa.Table, Tree, dict], pa.Table], schema: str) -> DataFrame:
    """``out`` for each block of ``nodes``, with its tree and the row of ``above`` (its node's path to the root, if any)."""
    dealt = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))

    def down(block: pa.Table, upper: pa.Table) -> pa.Table:
        if not block.num_rows:  # a group whose tree ended in an earlier round
            return out(block, Tree([], 0), {"path": [], "subroot": None, "root": None})
        block = block.sort_by("pos")
        tree = Tree(block["hash"].to_pylist(), _up(block["n"][0].as_py()))
        return out(block, tree, upper.slice(0, 1).to_pylist()[0])

    if above is None:
        def top(block: pa.Table) -> pa.Table:
            block = block.sort_by("pos")
            tree = Tree(block["hash"].to_pylist(), _up(block["n"][0].as_py()))
            return out(block, tree, {"path": [], "subroot": None, "root": tree.layers[-1][0]})

        return dealt.groupBy("g", "block").applyInArrow(top, schema)
    return dealt.groupBy("g", "block").cogroup(above.groupBy("g", "pos")).applyInArrow(down, schema)


def _paths(key: str) -> Callable[[pa.Table, Tree, dict], pa.Table]:
    """The path of every node of a block to the root, under ``key`` (the column that names the next tree down, or the group)."""

    def out(block: pa.Table, tree: Tree, upper: dict) -> pa.Table:
        m = block.num_rows
        above = [(p["left"], p["right"]) for p in upper["path"]]
        path = [[{"left": a, "right": z} for a, z in tree.path(i) + above] for i in range(m)]
        pos = block["pos"].to_pylist() if key == "g" else [0] * m
        subroot = [upper["subroot"]] * m if key == "g" else block["hash"].to_pylist()
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"g": pa.array(block[key].to_pylist(), pa.string()), "pos": pa.array(pos, pa.int64()), "path": pa.array(path, kind),
                         "subroot": pa.array(subroot, pa.string()), "root": pa.array([upper["root"]] * m, pa.string())})

    return out


def proofs(manifest: Manifest, changed: str = "changed", key: str = "doc_id", name: str = "merkle") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``changed`` is a column of the leaves: the leaf after tampering, or null.  Its version's root is folded_root;
    an untouched leaf is folded up from itself.  One tree of subroots is taken in one group: up to 4,096 groups, beyond
    that it is raised in rounds like any other.
    """
    schema = f"g string, pos bigint, path {_PATH}, subroot string, root string"
    tops = manifest.subroots
    starts, _, _ = _rounds(tops.select("g", "pos", "hash", "n"), f"{name}-top")
    above = None
    for k, nodes in reversed(list(enumerate(starts))):
        last = k == 0  # the subroots themselves: their paths go to the groups' trees
        if last:
            nodes = tops
        made = _below(nodes, above, _paths("of" if last else "g"), schema)
        above = written(made, f"{name}-top-paths-{k}")
    for k in range(len(manifest.rounds) - 1, 0, -1):
        # groups of a single node at this round have their path already, at position 0
        made = _below(manifest.rounds[k], above, _paths("g"), schema)
        ready = above.join(manifest.rounds[k].select("g").distinct(), "g", "left_anti")
        above = written(made.unionAll(ready), f"{name}-paths-{k}")

    def finish(block: pa.Table, tree: Tree, upper: dict) -> pa.Table:
        path = [(p["left"], p["right"]) for p in upper["path"]]
        rest = "".join(a + z for a, z in path)
        root, proof, folded = upper["root"], [], []
        for i, new in enumerate(block["changed"].to_pylist()):
            proof.append(H(*(a + z for a, z in tree.path(i)), rest))
            folded.append(fold(Version(tree, i, tree.layers[0][i] if new is None else new).top, path))
        m = block.num_rows
        return pa.table({"key": block["key"], "leaf": block["hash"], "subroot": pa.array([upper["subroot"]] * m, pa.string()), "root": pa.array([root] * m, pa.string()),
                         "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})

    leaves = manifest.leaves
    kind = leaves.schema[key].dataType.simpleString()
    rows = leaves.select("g", "pos", "n", F.col("leaf").alias("hash"), F.col(changed).alias("changed"), F.col(key).alias("key"))
    out = _below(rows, above, finish, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("key", key)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed): every row's leaf, and its leaf after tampering where 3 divides the crc32 of doc_id."""
    c = {x: F.col(x) for x in FIELDS}
    lowered = F.translate(c["text"], _UPPER, _UPPER.lower())
    tampered = F.crc32(c["doc_id"].cast("string").cast("binary")) % 3 == 0
    changed = F.when(tampered, leaf_hash([lowered if x == "text" else c[x] for x in FIELDS]))
    return docs.select("doc_id", "lang", leaf_hash([c[x] for x in FIELDS]).alias("leaf"), changed.alias("changed"))


def manifest(docs: DataFrame) -> DataFrame:
    """The published manifest: (lang, level, pos, hash) of every node, leaves at level 0."""
    m = build(leaves_of(docs), "lang", ["doc_id"])
    out = m.leaves.select("g", F.lit(0).alias("level"), "pos", F.col("leaf").alias("hash"))
    for k, nodes in enumerate(m.nodes):
        out = out.unionAll(nodes.where("level > 0").select("g", F.col("level") + k * DEPTH, "pos", "hash"))
    return out.select(F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("lang"), "level", "pos", "hash")


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(build(leaves_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lang", ["doc_id"]))


def _crc32_sql(value: str) -> str:
    """CRC-32 of a short ASCII string in DuckDB: two table steps of four bits for each byte."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    step = lambda c: f"xor(({c}) >> 4, t[CAST(({c}) & 15 AS INT) + 1])"
    fold_ = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(v) + 1), lambda k: CAST(ascii(v[k]) AS BIGINT))), lambda a, b: {step(step('xor(a, b)'))})"
    return f"(SELECT xor({fold_}, 4294967295) FROM (SELECT {value} AS v, {table}::BIGINT[] AS t))"


def _tree_sql(name: str, rows: str, depth: int) -> str:
    """CTEs of one forest: nodes of level k as <name><k> (g, p, h, c), c the nodes in their group; single nodes pass through."""
    out = [f"{name}0 AS ({rows})"]
    for k in range(1, depth + 1):
        below = f"{name}{k - 1}"
        out.append(f"""{name}{k}x AS (SELECT g, CASE WHEN c > 1 THEN p // {FANOUT} ELSE p END AS p, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE any_value(h) END AS h FROM {below} GROUP BY g, CASE WHEN c > 1 THEN p // {FANOUT} ELSE p END)""")
        out.append(f"{name}{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{k}x)")
    return ",\n".join(out)


def _siblings_sql(name: str, depth: int) -> str:
    """CTE <name>s: for each leaf (g, p) lists of the left and right siblings, level by level."""
    joins, left, right = [], [], []
    for k in range(depth):
        at = f"(z.p // {FANOUT**k})"
        run = f"x.g = z.g AND x.c > 1 AND x.p // {FANOUT} = {at} // {FANOUT}"
        left.append(f"(SELECT coalesce(string_agg(x.h, '' ORDER BY x.p), '') FROM {name}{k} x WHERE {run} AND x.p < {at})")
        right.append(f"(SELECT coalesce(string_agg(x.h, '' ORDER BY x.p), '') FROM {name}{k} x WHERE {run} AND x.p > {at})")
    return f"{name}s AS (SELECT z.g, z.p, [{', '.join(left)}] AS l, [{', '.join(right)}] AS r, [{', '.join(f'(SELECT any_value(x.c) > 1 FROM {name}{k} x WHERE x.g = z.g)' for k in range(depth))}] AS up FROM {name}0 z)"


def _sql(depth: int = 8, tops: int = 2) -> str:
    """Reference SQL for groups of up to 8 ** depth rows and 8 ** tops groups."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    lowered = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    top = f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS p, h, count(*) OVER () AS c, g AS of_g FROM n{depth}"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(lowered)} END AS changed FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
{_tree_sql('n', 'SELECT g, p, leaf AS h, count(*) OVER (PARTITION BY g) AS c FROM e', depth)},
{_siblings_sql('n', depth)},
{_tree_sql('t', top, tops)},
{_siblings_sql('t', tops)},
root AS (SELECT h AS root FROM t{tops}),
f AS (SELECT e.doc_id, e.leaf, coalesce(e.changed, e.leaf) AS start, t0.h AS subroot, list_concat(ns.l, ts.l) AS l, list_concat(ns.r, ts.r) AS r, list_concat(ns.up, ts.up) AS up
  FROM e JOIN ns ON ns.g = e.g AND ns.p = e.p JOIN t0 ON t0.of_g = e.g JOIN ts ON ts.p = t0.p),
o AS (SELECT doc_id, leaf, subroot, (SELECT root FROM root) AS root, sha256(list_reduce(list_prepend('', list_transform(range(1, {depth + tops} + 1), lambda k: l[k] || r[k])), lambda a, b: a || b)) AS proof_sha256,
  list_reduce(list_prepend(start, list_transform(range(1, {depth + tops} + 1), lambda k: CASE WHEN up[k] THEN l[k] || ':' || r[k] ELSE '' END)), lambda a, b: CASE WHEN b = '' THEN a ELSE sha256(split_part(b, ':', 1) || a || split_part(b, ':', 2)) END) AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM o
"""


SQL = _sql()
