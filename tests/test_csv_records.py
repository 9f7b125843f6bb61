"""CSV by header name, and quoted line breaks read by many tasks, against Python's csv module and Spark's multiLine."""

import csv
import io
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from basketry.sources import headers, records
from basketry.sources import loaders as L

SCHEMA = StructType([StructField("id", LongType()), StructField("city", StringType()), StructField("state", StringType())])


def put(folder, name, text, encoding="utf-8"):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding=encoding, newline="") as fh:
        fh.write(text)
    return str(folder)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in keep.items():
        spark.conf.set(k, v)


def test_columns_by_name(spark, tmp_path):
    put(tmp_path, "a.csv", "id,city,state\n1,sao paulo,SP\n")
    put(tmp_path, "b.csv", "﻿state, city ,id\nRJ,rio,2\n")
    put(tmp_path, "c.csv", "extra,id,state,city\nx,3,MG,\"bh, mg\"\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "only-header.csv", "city,state,id\n")
    put(tmp_path, "_hidden.csv", "nothing\n1\n")
    want = [(1, "sao paulo", "SP"), (2, "rio", "RJ"), (3, "bh, mg", "MG")]
    for multi_line in (False, True):
        df = L.read_csv(spark, str(tmp_path), SCHEMA, multi_line)
        assert df.columns == SCHEMA.names and rows(df) == want
    good, bad = L.read_csv_tolerant(spark, str(tmp_path), SCHEMA)
    assert rows(good) == want and bad == 0
    audit = L.load_tables(spark, [L.LoadSpec("t", str(tmp_path), SCHEMA)], f"{tmp_path}/out").first()
    assert (audit.status, audit.rows, audit.message) == ("loaded", 3, "unknown columns in c.csv: extra")


def test_missing_and_repeated_columns(spark, tmp_path):
    put(tmp_path / "m", "a.csv", "id,city\n1,x\n")
    put(tmp_path / "r", "a.csv", "id,city,state,city\n1,x,y,z\n")
    specs = [L.LoadSpec(t, f"{tmp_path}/{t}", SCHEMA) for t in ("m", "r")]
    audit = {r.table: r for r in L.load_tables(spark, specs, f"{tmp_path}/out").collect()}
    assert {r.status for r in audit.values()} == {"failed"}
    assert "missing columns in a.csv: state" in audit["m"].message and "columns named twice in a.csv: city" in audit["r"].message
    with pytest.raises(headers.ColumnsDiffer):
        L.read_csv(spark, f"{tmp_path}/m", SCHEMA)


def test_compressed_and_quoted_header(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt") as fh:
        fh.write('state,"city",id\nSP,"sp ""x""",7\n')
    assert rows(L.read_csv(spark, str(tmp_path), SCHEMA)) == [(7, 'sp "x"', "SP")]


FIELD = st.lists(st.sampled_from(['"', ",", "\n", "\r\n", "a", " ", "é", '""', "x,y"]), max_size=6).map("".join)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(FIELD, min_size=2, max_size=3), min_size=1, max_size=6))
def test_machine_finds_the_records(table):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(table)
    lines = out.getvalue().split("\n")[:-1]
    for start in range(len(lines) + 1):  # a split after any line
        inside, found, open_lines = False, [], []
        for k, line in enumerate(lines):
            if k == start:
                runs = [records._Run(False), records._Run(True)]
            inside = records.inside_after(line, inside)
            open_lines.append(line)
            if not inside:
                found.append("\n".join(open_lines))
                open_lines = []
        assert not inside and [next(csv.reader(io.StringIO(r, newline=""))) for r in found] == table
        state = False
        for line in lines[:start]:
            state = records.inside_after(line, state)
        if start < len(lines):
            run = runs[state]
            rest = [r for line in lines[start:] if (r := run.add(line, '"' in line)) is not None]
            assert found[len(found) - len(rest):] == rest and not run.open
            head = "\n".join(run.head) if run.head else None
            assert (head is not None) == state and (not state or found[len(found) - len(rest) - 1].endswith(head))


def reviews(n, seed):
    rng = random.Random(seed)
    words = ["good", "bad", 'a "quoted" word', "one, two", "line\nbreak", "\n\n", "crlf\r\nhere", '"', "5\" disk", "é🙂", "", " outer "]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(9))), rng.choice(["SP", "RJ"])) for k in range(n)]


@pytest.mark.parametrize("split", [2_000, 1 << 20])
def test_many_splits_equal_multi_line(spark, tmp_path, small_splits, split):
    table = reviews(1_200, split)
    table[700] = (700, "a very long one\n" * 900, "SP")  # spans many splits
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(SCHEMA.names)
    for k, row in enumerate(table):
        w.writerow(row)
        if k % 24 == 0:
            w.writerow((f"bad{k}", 'no\n"number"', "SP"))
    folder = put(tmp_path, "a.csv", out.getvalue() + '8000,5" disk,SP\n\n8001,"last, without an end","RJ"')
    put(tmp_path, "b.csv", 'city,state,id\r\n"x\r\ny",SP,9000\r\n  \r\n,,9001\r\n')  # a blank line is no record
    table += [(8000, '5" disk', "SP"), (8001, "last, without an end", "RJ"), (9000, "x\r\ny", "SP"), (9001, None, None)]
    small_splits(split)
    lines = records._lines(spark, [f"{folder}/a.csv"])
    assert (lines.rdd.getNumPartitions() > 10) == (split < 1 << 20)
    good, bad = L.read_csv_tolerant(spark, folder, SCHEMA, multi_line=True)
    assert bad == 50
    norm = lambda t: sorted(((i, c or None, s) for i, c, s in t), key=str)
    assert norm(good.collect()) == norm(table)
    os.remove(f"{folder}/b.csv")
    whole = spark.read.schema(StructType(SCHEMA.fields + [StructField(L.CORRUPT, StringType())])).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=L.CORRUPT).csv(folder)
    whole = whole.cache()
    assert whole.where(F.col(L.CORRUPT).isNotNull()).count() == 50
    mine = L.read_csv_tolerant(spark, folder, SCHEMA, multi_line=True)[0]
    assert rows(mine) == rows(whole.where(F.col(L.CORRUPT).isNull()).drop(L.CORRUPT))
    L.drop_staged(mine)
    with pytest.raises(L.TooManyBadRows):
        L.read_csv_tolerant(spark, folder, SCHEMA, max_bad_rows=49, multi_line=True)


def test_open_quote_at_the_end_of_a_file(spark, tmp_path, small_splits):
    put(tmp_path, "a.csv", 'id,city,state\n1,"never closed,SP\n2,x,y\n')
    put(tmp_path, "b.csv", "id,city,state\n" + "".join(f"{k},c,SP\n" for k in range(10, 60)))
    small_splits(100)
    got = records.csv_records(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")])
    assert sorted(r.record for r in got.collect()) == sorted(['1,"never closed,SP\n2,x,y', *(f"{k},c,SP" for k in range(10, 60))])


def test_texts_keep_their_outer_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, "  x ", "\t"), (2, "", None)], SCHEMA)
    L.write_csv(df, f"{tmp_path}/t")
    assert rows(L.read_csv(spark, f"{tmp_path}/t", SCHEMA)) == [(1, "  x ", "\t"), (2, None, None)]  # an empty text is read as null
