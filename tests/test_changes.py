"""Change capture, refreshes and workbooks beyond what the registered queries show."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from terrace.sources import readers, writers
from terrace.streaming import capture, refresh

SCHEMA = "k int, part string, v string, n double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


OLD = [(1, "a", "x", 1.0), (2, "a", None, 2.0), (3, "a", "z", None), (None, "a", "n", 4.0), (None, None, "m", 5.0), (5, "b", None, None), (6, "b", "gone", 0.0)]
NEW = [(1, "a", "x", 1.0), (2, "a", "y", 2.0), (3, "a", None, None), (None, "a", "n2", 4.0), (None, None, "m", 5.0), (5, "b", None, None), (7, "b", "new", 1.0)]


def test_changes_of_null_keys_and_values(spark):
    got = held(capture.changes(table(spark, OLD), table(spark, NEW), ["k", "part"], 3))
    assert got == sorted([(2, "a", "y", 2.0, "update", 3), (3, "a", None, None, "update", 3), (None, "a", "n2", 4.0, "update", 3), (6, "b", None, None, "delete", 3), (7, "b", "new", 1.0, "insert", 3)], key=str)
    assert held(capture.changes(table(spark, NEW), table(spark, NEW), ["k", "part"], 4)) == []


def test_values_do_not_pass_into_their_neighbours(spark):
    a, b = spark.createDataFrame([(1, None, "x")], "k int, a string, b string"), spark.createDataFrame([(1, "x", None)], "k int, a string, b string")
    assert capture.changes(a, b, ["k"], 1).count() == 1


def test_of_rows_that_repeat_a_key_the_largest_counts(spark):
    twice = table(spark, [(1, "a", "x", 1.0), (1, "a", "y", 1.0)])
    assert held(capture.changes(table(spark, []), twice, ["k", "part"], 1)) == [(1, "a", "y", 1.0, "insert", 1)]


@pytest.mark.parametrize("buckets", [1, 5])
def test_batches_may_be_applied_again(spark, tmp_path, buckets):
    old, new = table(spark, OLD), table(spark, NEW)
    kept = capture.KeptTable(spark, f"{tmp_path}/t", old.schema, ["k", "part"], buckets)
    one, two = capture.changes(old.limit(0), old, ["k", "part"], 1), capture.changes(old, new, ["k", "part"], 2)
    assert held(kept.read()) == []
    for batch, want in ((one, OLD), (one, OLD), (two, NEW), (two, NEW), (one.where("k = 1"), NEW), (one.union(two).where("k <> 6"), NEW)):
        kept.apply(batch)
        assert held(kept.read()) == sorted(want, key=str)
    kept.apply(capture.changes(new, new.limit(0), ["k", "part"], 3))
    assert held(kept.read()) == []  # every bucket has lost its last row
    kept.apply(one.limit(0))
    kept.apply(capture.changes(old.limit(0), old, ["k", "part"], 4))
    assert held(kept.read()) == sorted(OLD, key=str)


def test_a_change_rewrites_only_its_buckets(spark, tmp_path):
    schema = "k long, v string"
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    kept = capture.KeptTable(spark, f"{tmp_path}/t", rows.schema, ["k"], 16)
    kept.apply(capture.changes(rows.limit(0), rows, ["k"], 1))
    before = {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("t/*/*.parquet")}
    kept.apply(spark.createDataFrame([(5, "new", "update", 2)], schema + ", _change string, _version long"))
    after = {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("t/*/*.parquet")}
    assert len({f.parent for f in tmp_path.glob("t/*/*.parquet") if str(f) not in before}) == 1 and len(before) - 1 == sum(after.get(f) == at for f, at in before.items()) == 15
    assert kept.read().where("v = 'new'").count() == 1 and kept.read().count() == 1000


@pytest.mark.parametrize("when", ["before", "amid"])
def test_a_batch_that_is_cut_short_is_made_good(spark, tmp_path, monkeypatch, when):
    import shutil

    old, new = table(spark, OLD), table(spark, NEW)
    kept = capture.KeptTable(spark, f"{tmp_path}/t", old.schema, ["k", "part"], 4)
    kept.apply(capture.changes(old.limit(0), old, ["k", "part"], 1))
    batch = capture.changes(old, new, ["k", "part"], 2).cache()

    def cut(df, path, by):
        if when == "amid":  # an old bucket is gone, and the new one is not there yet
            shutil.rmtree(next(p for p in sorted(tmp_path.glob("t/_bucket=*")) if (tmp_path / "t.pending" / p.name).exists()))
        raise Cut

    with monkeypatch.context() as m:
        m.setattr(capture, "replace_partitions", cut)
        with pytest.raises(Cut):
            kept.apply(batch)
    kept.recover()
    assert held(kept.read()) == sorted(NEW, key=str)
    kept.apply(batch)
    assert held(kept.read()) == sorted(NEW, key=str) and not (tmp_path / "t.pending").exists()


def days(spark, *rows):
    return spark.createDataFrame([(i, dt.datetime.fromisoformat(at) if at else None, v) for i, at, v in rows], "id int, at timestamp_ntz, v int")


class Cut(Exception):
    pass


@pytest.mark.parametrize("point", ["_drop", "_advance"])
def test_a_refresh_that_is_cut_short_is_made_good(spark, tmp_path, monkeypatch, point):
    first = days(spark, (1, "2024-01-01", 1), (2, "2024-01-09 10:00:00", 1), (3, "2024-01-10", 1), (9, None, 1))
    second = days(spark, (1, "2024-01-01", 7), (2, "2024-01-09 10:00:00", 2), (4, "2024-01-08", 2), (5, "2024-01-12", 2), (6, "2024-01-02", 2))
    t = refresh.RefreshedTable(spark, f"{tmp_path}/t", "at", days=3)
    assert t.mark() is None
    t.refresh(first)
    assert t.mark() == dt.datetime(2024, 1, 10) and held(t.read().select("id", "v")) == [(1, 1), (2, 1), (3, 1)]

    def cut(*_):
        raise Cut

    with monkeypatch.context() as m:
        m.setattr(refresh.RefreshedTable, point, cut)
        with pytest.raises(Cut):
            t.refresh(second)
    assert t.mark() == dt.datetime(2024, 1, 10)
    for _ in range(2):  # and once more with nothing new
        t.refresh(second)
        assert t.mark() == dt.datetime(2024, 1, 12)
        assert held(t.read().select("id", "v")) == [(1, 1), (2, 2), (4, 2), (5, 2)]  # 3 is gone; 6 and the change of 1 come later than the range


def test_old_months_are_dropped(spark, tmp_path):
    t = refresh.RefreshedTable(spark, f"{tmp_path}/t", "at", days=40, keep_months=2)
    t.refresh(days(spark, (1, "2023-11-30", 1), (2, "2023-12-01", 1), (3, "2024-01-31", 1)))
    assert held(t.read().select("id")) == [(1,), (2,), (3,)]
    t.refresh(days(spark, (3, "2024-01-31", 1), (4, "2024-02-10", 1)))
    assert held(t.read().select("id")) == [(2,), (3,), (4,)]
    t.refresh(days(spark))
    assert held(t.read().select("id")) == [(2,)]  # the source has lost the days of the range


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def renamed(book, path, since_1904=False):
    """The workbook with its parts stored under the names of one another, and days from 1904 if so."""
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(path, "w") as b:
        for n in a.namelist():
            data = a.read(n).decode()
            if n == "xl/_rels/workbook.xml.rels":
                data = data.replace("sheet1", "sheetX").replace("sheet2", "sheet1").replace("sheetX", "sheet2")
            if n == "xl/workbook.xml" and since_1904:
                data = data.replace("<sheets>", '<workbookPr date1904="1"/><sheets>')
            b.writestr(n.replace("sheet1", "sheetX").replace("sheet2", "sheet1").replace("sheetX", "sheet2"), data)


def test_sheets_are_found_by_name_and_place(spark, tmp_path):
    renamed(writers.workbook({"first": [["id"], [1]], "second": [["id"], [2]]}), tmp_path / "a.xlsx")
    for sheet, want in ((1, [1]), (2, [2]), ("first", [1]), ("second", [2]), ("third", []), (3, [])):
        assert [r["id"] for r in readers.excel(spark, f"{tmp_path}/*.xlsx", "id int", sheet).collect()] == want


@pytest.mark.parametrize("since_1904", [False, True])
def test_days_and_whole_numbers_of_a_sheet(spark, tmp_path, since_1904):
    renamed(writers.workbook({"x": [[45000, 45000.75, 7.0, "7", True, 7.5], ["2023-03-15", "2023-03-15 18:00:00", "seven", 3, False, None], [1, 59, 1e12, "", None, "x"]], "y": []}), tmp_path / "a.xlsx", since_1904)
    got = [tuple(r) for r in readers.excel(spark, f"{tmp_path}/a.xlsx", "d date, t timestamp_ntz, n int, s string, b boolean, m long", header=False).collect()]
    late = dt.timedelta(days=1462 if since_1904 else 0)
    day, at = dt.date(2023, 3, 15), dt.datetime(2023, 3, 15, 18)
    assert got[0] == (day + late, at + late, 7, "7", True, None)
    assert got[1] == (day, at, None, "3", False, None)
    first = (dt.date(1904, 1, 2), dt.datetime(1904, 2, 29)) if since_1904 else (dt.date(1900, 1, 1), dt.datetime(1900, 2, 28))
    assert got[2] == (*first, None, "", None, None)


def test_scratch_removes_what_was_written_inside(spark):
    from pathlib import Path

    from terrace import shared

    df = spark.range(5)
    outer = shared.materialised(df)
    with shared.scratch(spark):
        one = shared.materialised(df)
        with shared.scratch(spark):
            two = shared.materialised(one)
            paths = [Path(x.inputFiles()[0].removeprefix("file://")).parent for x in (outer, one, two)]
            assert two.count() == 5 and all(p.exists() for p in paths)
        assert [p.exists() for p in paths] == [True, True, False]
    assert [p.exists() for p in paths] == [True, False, False] and outer.count() == 5
    with pytest.raises(Cut), shared.scratch(spark):
        three = shared.materialised(df)
        raise Cut
    assert not Path(three.inputFiles()[0].removeprefix("file://")).exists()
    shared.remove_folder(spark, str(paths[0]))


DERBY = {"host": "here", "database": "none", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_servers_are_read_side_by_side(spark):
    """Through a database that lives in this process: a table, a query, in parts by a column, with what is pushed down."""
    url = "jdbc:derby:memory:terrace;create=true"
    rows = spark.range(100).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("n"), "id").alias("NAME"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("PRICE"))
    rows.write.format("jdbc").options(url=url, dbtable="ITEMS", driver=DERBY["driver"]).save()
    for kind in ("postgresql", "mysql", "oracle", "db2"):
        got = readers.read(spark, kind, table="ITEMS", url=url, split=("ID", 0, 100, 4), **DERBY)
        assert got.rdd.getNumPartitions() == 4 and held(got) == held(rows)
    asked = readers.read(spark, "sql_server", query="SELECT ID, PRICE FROM ITEMS WHERE ID < 10", url=url, **DERBY)
    assert held(asked.where("PRICE > 8")) == [(6, 9.0), (8, 12.0), (9, 13.5)]
    one = readers.read(spark, "essbase", url=url, driver=DERBY["driver"], dbtable="ITEMS").where("ID = 5").select("NAME")
    assert [r[0] for r in one.collect()] == ["n5"] and "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,5)]" in one._jdf.queryExecution().toString()


def test_catalog_kinds_read_the_sessions_tables(spark):
    spark.range(3).createOrReplaceTempView("catalogued")
    for kind in readers.CATALOG:
        assert readers.read(spark, kind, table="catalogued").count() == 3
