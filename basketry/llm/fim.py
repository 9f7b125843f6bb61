"""Fill-in-middle transformation: two cuts at random unit boundaries, located by a wavelet matrix.

The UTF-8 bytes of a slice of texts are mapped to eight character classes
(continuation byte, letter, digit, blank, line feed, other ASCII, lead of two
bytes, lead of three or four) and put in a wavelet matrix.  A unit's boundary
is a set of classes: a code point starts at every byte that is not a
continuation, a line ends at every line feed.  The number of boundaries up to a
byte is a combination of rank queries, so the units of a text are counted, and
both cuts of every text of the slice are found by one bisection on ranks over
all of them, without decoding any text.

The cuts and the form come from the sha256 of ``<seed>:<doc_id>``: with h1 to
h4 its first four 8-digit groups and n the units, the prefix ends after
min(h1 % (n + 1), h2 % (n + 1)) units and the middle after the larger.
``plain`` (unchanged) is a text that is empty, holds a sentinel or has
h3 % 100 >= ``rate``; ``spm`` has h4 % 100 < ``spm``; all others are ``psm``.
A sentinel starts with ``<`` and ends with ``>`` and has neither inside, so none
can arise where two parts meet, and ``restored`` splits the output exactly.

One scan, nothing shuffled or broadcast.  A task holds one slice of about 2 MB
and its matrix (three levels of bits); one longer text is a slice of its own.

Defined cases: null texts count as empty; an empty text is plain with no units.
A null doc_id hashes as ``<seed>:``.  Repeated rows are cut alike, each a row of
its own.  Very long texts are cut whole (a Spark string's own bound).  Empty
tables give an empty result; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import text as tx
from basketry.llm.wavelet import WaveletMatrix

CONTINUATION, LETTER, DIGIT, BLANK, LINE_FEED, OTHER, LEAD_2, LEAD_3 = range(8)
CLASS_BITS = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def _class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1] = LETTER
    table[ord("0"):ord("9") + 1] = DIGIT
    table[[ord(" "), ord("\t")]] = BLANK
    table[ord("\n")] = LINE_FEED
    table[0x80:0xC0] = CONTINUATION
    table[0xC0:0xE0] = LEAD_2
    table[0xE0:] = LEAD_3
    return table


_CLASS = _class_table()


@dataclass(frozen=True)
class Unit:
    """``starts``: a unit starts at each byte of ``classes``; else one ends after each, and bytes after the last are one more."""

    classes: frozenset[int]
    starts: bool


UNITS = {
    "char": Unit(frozenset(range(8)) - {CONTINUATION}, True),
    "line": Unit(frozenset([LINE_FEED]), False),
}


def _last_within(matrix: WaveletMatrix, unit: Unit, start: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each text the largest byte position p with at most ``most`` boundaries in start..p: bisection on ranks."""
    base = matrix.count(start, unit.classes)
    low, high = start.copy(), end.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        ok = matrix.count(mid, unit.classes) - base <= most
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def count_units(matrix: WaveletMatrix, unit: Unit, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = matrix.count(end, unit.classes) - matrix.count(start, unit.classes)
    if not unit.starts:
        open_end = end > start
        open_end[open_end] = ~np.isin(_CLASS[data[end[open_end] - 1]], list(unit.classes))
        n = n + open_end
    return n


def locate(matrix: WaveletMatrix, unit: Unit, start: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The byte position after the first ``units`` units of each text."""
    if unit.starts:
        return _last_within(matrix, unit, start, end, units)
    return np.where(units > 0, np.minimum(_last_within(matrix, unit, start, end, units - 1) + 1, end), start)


def transform(docs: DataFrame, unit: str = "char", seed: int = 1, rate: int = 90, spm: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_units, form, prefix_units, middle_units, output) for every row; the unit counts are null where plain."""
    by = UNITS[unit]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, off in tx.slices(b, "text"):
                h1, h2, h3, h4 = (rows.column(f"h{k}").to_numpy() for k in range(1, 5))
                start, end = off[:-1], off[1:]
                matrix = WaveletMatrix(_CLASS[data], CLASS_BITS)
                n = count_units(matrix, by, data, start, end)
                one, two = h1 % (n + 1), h2 % (n + 1)
                a, z = np.minimum(one, two), np.maximum(one, two)
                at, to = locate(matrix, by, start, end, a), locate(matrix, by, start, end, z)
                whole = data.tobytes()
                forms, outputs = [], []
                for s, p, m, e, x, y in zip(start.tolist(), at.tolist(), to.tolist(), end.tolist(), h3.tolist(), h4.tolist()):
                    t = whole[s:e]
                    if not t or x % 100 >= rate or PREFIX in t or SUFFIX in t or MIDDLE in t:
                        forms.append("plain")
                        outputs.append(t)
                        continue
                    prefix, middle, suffix = whole[s:p], whole[p:m], whole[m:e]
                    if y % 100 < spm:
                        forms.append("spm")
                        outputs.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
                plain = np.array([f == "plain" for f in forms], bool)
                columns = [rows.column("doc_id"), pa.array(n), pa.array(forms, pa.string()), pa.array(a, mask=plain), pa.array(z - a, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_units", "form", "prefix_units", "middle_units", "output"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *hashes).mapInArrow(
        cut, f"doc_id {kind}, n_units bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
v AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, z - a) AS m, substr(t, z + 1) AS s FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(z - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM w
"""


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
