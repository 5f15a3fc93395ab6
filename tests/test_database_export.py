"""Database source and sink, delimited export, distributed numbering, and the salted panel join."""

import csv
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from newsrank.operators import ordering as OR
from newsrank.operators import panel as PN
from newsrank.sources import database as DB
from newsrank.sources import export as EX
from newsrank.sources import tables as TB


def test_database_reads_in_ranges_with_pushed_filters(spark):
    db, table = DB.embedded(spark, f"db{uuid.uuid4().hex[:8]}"), "T1"
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n"), F.concat(F.lit("é"), "id").alias("t"))
    assert not db.has(table) and db.replace(rows, table) == 1000 and db.has(table)
    read = db.read(table, "id", 8)
    assert read.rdd.getNumPartitions() == 8
    some = read.where("n = 3")
    assert "EqualTo(n,3)" in DB.pushed_filters(some)
    assert sorted(map(tuple, some.collect())) == sorted((i, 3, f"é{i}") for i in range(1000) if i % 7 == 3)


def test_database_swap_is_whole(spark, monkeypatch):
    db = DB.embedded(spark, f"db{uuid.uuid4().hex[:8]}")
    old = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "id long, n long")
    assert db.replace(old, "T2") == 3
    assert sorted(map(tuple, db.read("T2", "id").collect()), key=str) == [(1, 5), (2, 6), (None, 7)]
    assert db.replace(old.limit(0), "T3") == 0 and db.read("T3", "id").count() == 0
    new = spark.createDataFrame([(2, 60), (3, 70)], "id long, n long")
    db.upsert(new, "T2", "id", lambda a, b: TB.merge_by_key(a.where("id is not null"), b, "id", ["n"]))
    assert sorted(map(tuple, db.read("T2", "id").collect())) == [(1, 5), (2, 60), (3, 70)]
    # rows staged twice are noticed, and the table stays as it was
    monkeypatch.setattr(DB, "cut_lineage", lambda df: _Twice(df))
    with pytest.raises(RuntimeError):
        db.replace(new, "T2")
    assert db.read("T2", "id").count() == 3


class _Twice:
    """A frame that counts its rows once and writes them twice."""

    def __init__(self, df):
        self.df = df

    def count(self):
        return self.df.count()

    def coalesce(self, n):
        return self.df.unionByName(self.df).coalesce(n)


HARD = ['tab\there', 'quote " inside', '"', 'line\nend', ' blanks ', '', None, 'é,;', '=1+1', "a'b\\"]


def test_export_reads_as_a_csv_reader_reads_it(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame(list(enumerate(HARD)), "i long, t string")
    titles = {"i": "number", "t": "text\twith tab"}
    for sep, bom, size in (("\t", False, 1000), (",", True, 1000), ("\t", False, 3)):
        files = EX.export(rows, titles, folder, f"x{size}{bom}", ["i"], sep, bom, size)
        assert len(files) == (1 if size == 1000 else 4)
        got = []
        for name in files:
            text = open(f"{folder}/{name}", encoding="utf-8", newline="").read()
            assert text.startswith("﻿") == bom
            lines = list(csv.reader(text.removeprefix("﻿").splitlines(keepends=True), delimiter=sep))
            assert lines[0] == list(titles.values())
            got += [tuple(r) for r in lines[1:]]
        assert got == [(str(i), t or "") for i, t in enumerate(HARD)]
        back = EX.read_export(spark, [f"{folder}/{f}" for f in files], titles, sep).collect()
        assert sorted((int(r.i), r.t or "") for r in back) == [(i, t or "") for i, t in enumerate(HARD)]
    assert EX.export(rows.limit(0), titles, folder, "none", ["i"]) == ["none.tsv"]
    assert open(f"{folder}/none.tsv").read() == "number\ttext\twith tab\n"


def test_run_table(spark):
    runs = spark.createDataFrame([("d", "u", "m", None, "t", None, 1, 2, None, "bad", 0.5, None, None, None, None, 0.1, None),
                                  ("d", "u", "m", 3, "t", 0.5, 9, 2, 7.5, None, None, True, "q", "r", "s", 0.1, "x")],
                                 "created_at string, run_uid string, input_mode string, event_id long, news_title string, importance_score double, persona_id long, persona_version int, "
                                 "score double, error string, human_score double, is_understandable boolean, assessment string, reason string, suggestion string, cost_usd double, model string")
    names = spark.createDataFrame([(1, "one")], "id long, name string")
    got = [(r.persona, r.score, r.understandable) for r in EX.run_table(runs, names).orderBy("persona").collect()]
    assert got == [("9（已删除）", "7.5", "是"), ("one", "失败：bad", "")]


def test_numbering_and_running_totals(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("o"), "id")
    want, place = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, r.o, r.id)):
        place[r.g] = place.get(r.g, 0) + 1
        want[r.id] = place[r.g]
    assert {r.id: r.n for r in OR.numbered_within(rows, "g", ["o", "id"], "n").collect()} == want
    assert [r.n for r in OR.numbered(rows, ["o", "id"], "n").orderBy("o", "id").collect()] == list(range(1, 501))
    for by in ([], ["g"]):
        counts = rows.groupBy(*by, "o").agg(F.count("*").alias("k"))
        got = OR.running_total(counts, by, "o", "k", "upto").collect()
        assert all(r.upto == sum(x.k for x in got if x.o <= r.o and all(x[c] == r[c] for c in by)) for r in got) and len(got) == counts.count()


def test_salted_panel_equals_the_shipped_one(spark):
    holders = spark.range(3000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 > 0, "C0").otherwise(F.concat(F.lit("C"), F.col("id") % 8)).alias("coin"))
    shocks = spark.range(80).select(F.concat(F.lit("C"), F.col("id") % 8).alias("coin"), (F.col("id") / 8).cast("int").alias("day"), (F.col("id") % 3).cast("int").alias("shock"))
    shipped = PN.with_shocks(holders, shocks)
    salted = PN.with_shocks(holders, shocks, salts=16, shipped_rows=0)
    cols = ["user_id", "coin", "day", "shock"]
    assert salted.count() == shipped.count() and salted.select(cols).exceptAll(shipped.select(cols)).isEmpty()
    # a coin of two thirds of the rows is dealt evenly: parts of one coin differ by little
    parts = holders.where("coin = 'C0'").groupBy(F.pmod(F.xxhash64("user_id"), F.lit(16))).count().agg(F.max("count"), F.expr("median(count)")).first()
    assert parts[0] <= 3 * parts[1]


def test_long_rows_make_shorter_sheets(spark, tmp_path):
    from newsrank.sources import export as EX

    df = spark.range(40).selectExpr("id AS a", "repeat('x', 98) AS b")
    files = EX.export(df, {"a": "A", "b": "B"}, str(tmp_path), "t", ["a"], sheet_bytes=1010)
    assert len(files) == 5 or len(files) == 4
    assert max((tmp_path / f).stat().st_size for f in files) < 1200
    back = EX.read_export(spark, [f"{tmp_path}/{f}" for f in files], {"a": "A", "b": "B"})
    assert sorted(int(r.a) for r in back.collect()) == list(range(40))
