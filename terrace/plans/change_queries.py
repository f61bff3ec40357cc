"""Queries of tables that follow their sources, and of workbooks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..shared import materialised, new_folder
from ..sources import readers, writers
from ..streaming import capture, incremental, refresh
from .catalogue import query


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 3
UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 13 = 0""")
def stream_captured(t):
    """Two snapshots of the orders: the second has changed, missing and new rows. The changes between them are streamed into a
    kept table, which then is the second."""
    first, spark = t("orders"), t.spark
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    priority = F.when(F.col("o_orderkey") % 10 != 1, F.col("o_orderpriority"))
    second = first.where("o_orderkey % 11 <> 3").withColumns({"o_totalprice": price, "o_orderpriority": priority})
    second = second.unionByName(first.where("o_orderkey % 13 = 0").withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("N")}))
    feed, kept, at = new_folder(t.spark, "changes"), capture.KeptTable(spark, new_folder(t.spark, "kept"), first.schema, ["o_orderkey"], buckets=8), new_folder(t.spark, "stream")
    for version, (old, new) in enumerate(((first.limit(0), first), (first, second)), 1):
        found = capture.changes(old, new, ["o_orderkey"], version)
        found.write.mode("append").parquet(feed)
        capture.keep_up(incremental.watch(spark, feed, found.schema), kept, at).awaitTermination()
    return kept.read()


@query("SELECT CASE WHEN o_orderkey % 11 = 3 THEN 'delete' ELSE 'update' END AS kind, count(*) AS n FROM orders WHERE o_orderkey % 11 = 3 OR o_orderkey % 7 = 0 AND o_totalprice IS NOT NULL GROUP BY 1")
def stream_changes(t):
    first = t("orders")
    second = first.where("o_orderkey % 11 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return capture.changes(first, second, ["o_orderkey"], 2).groupBy(F.col("_change").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_refreshed(t):
    """Three refreshes, each from the source as it is by then: every seventeenth row comes two days late, and every nineteenth is
    corrected a day after it came."""
    events = t("events").select("event_id", "ts", "user_id", "event_type", "value")
    table = refresh.RefreshedTable(t.spark, new_folder(t.spark, "refreshed"), "ts", days=3)
    for day in (10, 20, 40):
        now = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(day))
        since = lambda days: F.col("ts") < now - F.make_dt_interval(F.lit(days))  # noqa: B023, E731
        value = F.when((F.col("event_id") % 19 != 0) | since(1), F.col("value")).otherwise(-F.col("value"))
        table.refresh(events.where(since(0) & ((F.col("event_id") % 17 != 0) | since(2))).withColumn("value", value))
    return table.read()


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day, o_orderdate + INTERVAL 12 HOUR AS noon, o_orderpriority, CAST(o_orderkey % 2 = 0 AS BOOLEAN) AS even FROM orders")
def source_excel(t):
    """Workbooks of 2,000 orders each, read again: the orders are on the second tab, numbers are doubles, dates numbers of days."""

    def booked(rows: pd.DataFrame) -> pd.DataFrame:
        cells = [[float(r.o_orderkey), r.o_totalprice, r.o_orderdate.date(), r.o_orderdate.to_pydatetime() + pd.Timedelta(hours=12).to_pytimedelta(), r.o_orderpriority, r.o_orderkey % 2 == 0] for r in rows.itertuples()]
        return pd.DataFrame({"content": [writers.workbook({"notes": [["nothing here"]], "orders & more": [["key", "price", "day", "noon", "priority", "even"], *cells]})]})

    books = materialised(t("orders").groupBy(F.floor(F.col("o_orderkey") / 2000)).applyInPandas(booked, "content binary"))
    return readers.workbook_rows(books, "o_orderkey long, o_totalprice double, day date, noon timestamp_ntz, o_orderpriority string, even boolean", sheet="orders & more")
