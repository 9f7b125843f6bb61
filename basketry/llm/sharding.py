"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has 65,536 positions.  Each shard owns ``vnodes`` points on it; a row hashes
to a position and belongs to the next point clockwise (its arc).  Every shard has a bound.
With ``load_factor`` 1 the bounds are the row count divided by the shards, rounded down or
up, so row counts differ by at most one (the law ``rows``); larger factors move
fewer rows and balance less exactly.  Rows that their shard has no room for
walk on clockwise, first come first served, and fill the first shard with room.

Only the row counts of the positions (65,536 numbers whatever the data) decide the walk:

1. count the rows of each position (combined before the shuffle);
2. fold the arcs twice round the ring, in one row of that bounded size: which ranks
   of an arc stay, which overflow, and which part of the overflow each shard takes;
3. number the rows of each position in hash order (the only shuffle: key, size,
   checksum; no text) and look up (arc, rank) in the segments, a broadcast of
   a few times shards x vnodes rows.

Defined cases: a null text has size 16 and the checksum of no bytes; a null doc_id is
a key like any other.  Repeated rows are neighbours on the ring and each gets a slot.  Fewer
rows than shards leave shards empty.  An empty table gives an empty result.  Other columns
do not take part.  Rows with equal texts are placed one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAW = "rows"
POSITIONS = 1 << 16


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(arc, shard, until): the points in clockwise order, each with its position."""
    points = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.explode(F.expr(f"sequence(0, {vnodes - 1})")).alias("v"))
    points = points.select(F.pmod(F.xxhash64(F.lit("node"), "shard", "v"), F.lit(POSITIONS)).alias("until"), "shard", "v")
    packed = points.agg(F.sort_array(F.collect_list(F.struct("until", "shard", "v"))).alias("p"))  # shards x vnodes entries
    return packed.select(F.posexplode("p").alias("arc", "x")).select(F.col("arc").cast("bigint").alias("arc"), "x.shard", "x.until")


def _positions(nodes: DataFrame) -> DataFrame:
    """(pos, arc) of every position of the ring: the first point at or after it, or the first of all."""
    ends = nodes.groupBy("until").agg(F.min("arc").alias("arc"))
    ends = ends.agg(F.sort_array(F.collect_list(F.struct("until", "arc"))).alias("e"))
    spans = ends.select(F.expr("transform(e, (x, k) -> struct(if(k = 0, 0, e[k - 1].until + 1) as lo, x.until as hi, x.arc as arc))").alias("s"))
    spans = spans.select(F.explode(F.expr(f"concat(s, array(struct(s[size(s) - 1].hi + 1 as lo, {POSITIONS - 1}L as hi, s[0].arc as arc)))")).alias("x"))
    return spans.where("x.lo <= x.hi").select(F.explode(F.expr("sequence(x.lo, x.hi)")).alias("pos"), "x.arc")


#: One step of the walk at a point: its own rows first, then rows that wait, in the order they began to wait.
_STEP = """
aggregate(
  steps,
  named_struct('used', array_repeat(0L, {shards}), 'head', 0L, 'tail', 0L,
               'stay', cast(array() as array<struct<arc: bigint, lo: bigint, hi: bigint, shard: int, slot: bigint>>),
               'wait', cast(array() as array<struct<arc: bigint, lo: bigint, hi: bigint, at: bigint>>),
               'take', cast(array() as array<struct<at: bigint, n: bigint, shard: int, slot: bigint>>)),
  (s, x) -> aggregate(
    array(named_struct('own', least(x.n, caps[x.shard] - s.used[x.shard]), 'had', s.used[x.shard], 'room', caps[x.shard] - s.used[x.shard])),
    s,
    (t, y) -> named_struct(
      'used', transform(t.used, (u, k) -> if(k = x.shard, u + y.own + least(y.room - y.own, t.tail + x.n - y.own - t.head), u)),
      'head', t.head + least(y.room - y.own, t.tail + x.n - y.own - t.head),
      'tail', t.tail + x.n - y.own,
      'stay', if(y.own > 0, concat(t.stay, array(named_struct('arc', x.arc, 'lo', 0L, 'hi', y.own, 'shard', x.shard, 'slot', y.had))), t.stay),
      'wait', if(x.n > y.own, concat(t.wait, array(named_struct('arc', x.arc, 'lo', y.own, 'hi', x.n, 'at', t.tail))), t.wait),
      'take', if(least(y.room - y.own, t.tail + x.n - y.own - t.head) > 0,
                 concat(t.take, array(named_struct('at', t.head, 'n', least(y.room - y.own, t.tail + x.n - y.own - t.head), 'shard', x.shard, 'slot', y.had + y.own))),
                 t.take))))
"""
_SEGMENTS = """
concat(w.stay, flatten(transform(w.wait, p -> transform(
  filter(w.take, t -> t.at < p.at + p.hi - p.lo and t.at + t.n > p.at),
  t -> named_struct('arc', p.arc, 'lo', p.lo + greatest(t.at, p.at) - p.at, 'hi', p.lo + least(t.at + t.n, p.at + p.hi - p.lo) - p.at,
                    'shard', t.shard, 'slot', t.slot + greatest(t.at, p.at) - t.at)))))
"""


def _walk(nodes: DataFrame, counts: DataFrame, shards: int, load_factor: float) -> DataFrame:
    """(arc, lo, hi, shard, slot): ranks lo..hi-1 of an arc go to the slots of a shard from ``slot`` on."""
    points = nodes.join(counts, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    packed = points.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "n"))).alias("p"), F.sum("n").alias("total"))
    even = f"transform(sequence(0, {shards - 1}), k -> total div {shards} + if(k < total % {shards}, 1L, 0L))"
    loose = f"array_repeat(cast(ceil({load_factor} * total / {shards}) as bigint), {shards})"
    packed = packed.select(F.expr(even if load_factor == 1 else loose).alias("caps"), F.expr("concat(p, transform(p, x -> named_struct('arc', x.arc, 'shard', x.shard, 'n', 0L)))").alias("steps"))
    walked = packed.select(F.expr(_STEP.format(shards=shards)).alias("w")).select(F.explode(F.expr(_SEGMENTS)).alias("x"))
    return walked.select(F.col("x.arc").alias("s_arc"), "x.lo", "x.hi", "x.shard", "x.slot")


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 64, load_factor: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    raw = F.coalesce(F.col(text).cast("binary"), F.expr("X''"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 16).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("point", F.xxhash64(F.lit("row"), "doc_id", "text_crc32", "size"))
    rows = rows.withColumn("pos", F.pmod("point", F.lit(POSITIONS)))
    nodes = ring(docs.sparkSession, shards, vnodes)
    counts = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).join(_positions(nodes), "pos")
    before = Window.partitionBy("arc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # of the 65,536 positions
    offsets = counts.select("pos", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    segments = _walk(nodes, counts.groupBy("arc").agg(F.sum("n").alias("n")), shards, load_factor)

    order = Window.partitionBy("pos").orderBy("point", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("bigint") - 1)
    ranked = ranked.join(F.broadcast(offsets), "pos").withColumn("rank", F.col("rank") + F.col("offset"))
    hit = (F.col("arc") == F.col("s_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    out = ranked.join(F.broadcast(segments), hit)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("slot") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
