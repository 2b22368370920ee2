"""Queries that write landing files, snapshots and exports from the given tables and read them back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from ..sources import landing, store
from ..sources.snapshots import Snapshots
from ..streaming import ticks
from .base import B1, B3, Tables, query

# ---- files -------------------------------------------------------------------------------------

CENTS = "FLOOR(close * 100) / 100"


def _write_csv(df: DataFrame, path: str, sep: str) -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


@query("bar_files_of_several_layouts", "S1", "sym d:date close:2 volume freq",
       B1 + f", q AS (SELECT sym, d, {CENTS} AS close, volume, freq FROM bars)")
def _(t: Tables):
    """Three layouts in one folder: other headers, column orders, date formats and separators."""
    bars = t.bars(windows=False).select("sym", "d", (F.floor(F.col("close") * 100) / 100).alias("close"), "volume", "freq").withColumn(
        "k", F.substring("sym", 2, 20).cast("long") % 3)
    path = work_path(t.spark, "layouts")
    day = F.date_format("d", "dd/MM/yyyy")
    text = lambda c: F.col(c).cast("string")
    layouts = (
        (",", {"Date": F.col("d").cast("string"), "Stock Code": F.col("sym"), "Close": text("close"), "Volume": text("volume"), "Frequency": text("freq")}),
        (";", {"Frekuensi": text("freq"), "Kode Saham": F.lower("sym"), "Catatan": F.lit("a;b"), "Volume": text("volume"), "Penutupan": text("close"), "Tanggal": day}),
        ("|", {"volume": text("volume"), "freq": text("freq"), "ticker": F.col("sym"), "closing_price": text("close"), "trade date": day}),
    )
    for k, (sep, columns) in enumerate(layouts):
        _write_csv(bars.where(F.col("k") == k).select(*[c.alias(name) for name, c in columns.items()]), f"{path}/layout{k}", sep)
    return landing.read_bars(t.spark, path)


def _payloads(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """One JSON text per date, as the exchange delivers it."""
    record = F.struct(*[c.alias(name) for name, c in fields.items()])
    return rows.groupBy(F.col("d").alias("day")).agg(F.to_json(F.struct(
        F.count(F.lit(1)).alias("recordsTotal"), F.collect_list(record).alias("data"))).alias("payload"))


@query("json_snapshot_bars", "S5", "sym d:date close:4 high:4 volume value:2 freq fbuy:2 declared received:int",
       B3 + """, n AS (SELECT d, COUNT(*) AS k FROM bars GROUP BY d),
       q AS (SELECT sym, bars.d, close, high, volume, value, freq, fbuy, n.k AS declared, n.k AS received FROM bars JOIN n ON bars.d = n.d WHERE NOT (day(bars.d) = 7 AND sym = 'Brand#11'))""")
def _(t: Tables):
    """A record dated otherwise than its snapshot is dropped, and still counts as received."""
    stale = (F.dayofmonth("d") == 7) & (F.col("sym") == "Brand#11")
    raw = _payloads(t.brand_bars(), {
        "Date": F.concat(F.when(stale, F.date_sub("d", 1)).otherwise(F.col("d")).cast("string"), F.lit("T00:00:00")),
        "StockCode": F.concat(F.lit(" "), F.lower("sym")), "Close": F.col("close"), "High": F.col("high").cast("string"), "Volume": F.col("volume").cast("string"),
        "Value": F.col("value"), "Frequency": F.col("freq"), "ForeignBuy": F.col("fbuy"), "Previous": F.lit("")})
    # Codes are upper-cased; the brand names' own spelling is put back.
    return landing.parse_snapshot(raw).withColumn("sym", F.replace("sym", F.lit("BRAND"), F.lit("Brand")))


@query("json_snapshot_indices", "S6", "index_code d:date close:4 low:4 volume stocks:int",
       B3 + """, q AS (SELECT upper(substr(sym, 1, 7)) AS index_code, d, MAX(close) AS close, MIN(low) AS low, CAST(SUM(volume) AS BIGINT) AS volume, COUNT(*) AS stocks FROM bars GROUP BY 1, d)""")
def _(t: Tables):
    rows = t.brand_bars().groupBy(F.substring("sym", 1, 7).alias("code"), "d").agg(
        F.max("close").alias("close"), F.min("low").alias("low"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
    return landing.parse_index_snapshot(_payloads(rows, {
        "Date": F.col("d").cast("string"), "IndexCode": F.col("code"), "Close": F.col("close"), "Lowest": F.col("low"), "Volume": F.col("volume"), "NumberOfStock": F.col("n")}))


@query("files_new_to_the_ledger", "S10", "payload",
       B1 + """, m AS (SELECT strftime(d, '%Y') AS y, strftime(d, '%Y-%m') || ':' || COUNT(*) AS payload FROM bars GROUP BY 1, strftime(d, '%Y-%m')),
       q AS (SELECT payload FROM m WHERE CAST(y AS INT) % 2 = 0)""")
def _(t: Tables):
    """A file per month, of which the odd years' are in the ledger already; each is landed twice."""
    months = t.bars(windows=False).groupBy(F.date_format("d", "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n")).select(
        "m", F.concat_ws(":", "m", "n").alias("value"))
    path = work_path(t.spark, "ledger")
    for copy in ("a", "b"):
        months.repartition("m").write.option("lineSep", "#").partitionBy("m").text(f"{path}/copy={copy}")
    files = lambda ledger: landing.ingest_files(t.spark, f"{path}/*/*/*.txt", ledger)
    ledger = files(None).where(F.substring("payload", 1, 4).cast("int") % 2 == 1).select("sha256")
    return files(ledger).select(F.replace("payload", F.lit("#"), F.lit("")).alias("payload"))


@query("committed_snapshots", "S18 S10", "sym d:date close:4 batch row_count",
       B1 + """, z AS (SELECT MAX(d) AS z FROM bars), n AS (SELECT d, COUNT(*) AS row_count FROM bars GROUP BY d),
       q AS (SELECT sym, bars.d, CASE WHEN bars.d > z.z - 60 THEN close * 2 ELSE close END AS close,
         CASE WHEN bars.d > z.z - 60 THEN 'b2' ELSE 'b1' END AS batch, row_count FROM bars JOIN n ON n.d = bars.d, z WHERE bars.d < z.z - 5)""")
def _(t: Tables):
    """All dates; a correction of the last sixty days that dies once and is repeated; the last six days emptied; a batch
    that is written and never published."""
    bars = t.bars(windows=False).select("sym", "d", "close")
    last = bars.agg(F.max("d").alias("z")).first().z
    table = Snapshots(t.spark, work_path(t.spark, "snapshots"))
    table.commit(bars, "b1")
    late = bars.where(F.col("d") > F.lit(last - dt.timedelta(days=60)))
    table.prepare(late.withColumn("close", F.lit(-1.0)), "b2")
    table.commit(late.withColumn("close", F.col("close") * 2), "b2")
    table.commit(bars.where("false"), "b3", dates=bars.select("d").distinct().where(F.col("d") >= F.lit(last - dt.timedelta(days=5))))
    table.prepare(bars.withColumn("close", F.lit(0.0)), "b4")
    return table.read().join(table.log().select("d", "batch", "row_count"), "d")


@query("exported_files", "S21", "kind sym d:date close:4 volume:int name",
       B1 + """, q AS (SELECT kind, sym, d, close, volume, 'a "b", c' AS name FROM bars, (SELECT UNNEST(['csv', 'json', 'parquet']) AS kind))""")
def _(t: Tables):
    """What the sinks write, as a reader finds it: a mark before the first header, quotes doubled, NULL fields kept."""
    bars = t.bars(windows=False).select("sym", "d", "close", "volume", F.lit('a "b", c').alias("name"), F.lit(None).cast("string").alias("nothing"))
    path = work_path(t.spark, "exports")
    store.write_bars(bars, f"{path}/parquet")
    # The bars are worked out once; the text sinks write what was stored.
    stored = t.spark.read.parquet(f"{path}/parquet").select(*bars.columns)
    store.write_csv(stored, f"{path}/csv")
    store.write_json(stored, f"{path}/json")
    csv = t.spark.read.csv(f"{path}/csv", header=True, escape='"')
    csv = csv.withColumnRenamed(csv.columns[0], csv.columns[0].removeprefix(store.BOM))
    found = {"csv": csv, "json": t.spark.read.schema(csv.schema).json(f"{path}/json"), "parquet": t.spark.read.parquet(f"{path}/parquet")}
    out = None
    for kind, df in found.items():
        rows = df.where("nothing is null or nothing = ''").select(
            F.lit(kind).alias("kind"), "sym", F.col("d").cast("date").alias("d"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- sessions ----------------------------------------------------------------------------------

@query("tick_sessions", "T3", "sym start finish open:4 close:4 high:4 low:4 volume freq value:3",
       """e AS (SELECT user_id % 50 || ':' || event_type AS sym, ts, value AS price, event_id FROM events),
       s AS (SELECT *, CASE WHEN ts - LAG(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY sym ORDER BY ts, event_id)),
       n AS (SELECT *, SUM(new) OVER (PARTITION BY sym ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s),
       q AS (SELECT sym, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS finish,
         arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS close, MAX(price) AS high, MIN(price) AS low, COUNT(*) AS volume, COUNT(*) AS freq,
         CAST(SUM(CAST(price AS DECIMAL(28,4))) AS DOUBLE) AS value FROM n GROUP BY sym, k)""")
def _(t: Tables):
    rows = t.table("events").select(
        "ts", F.concat_ws(":", (F.col("user_id") % 50).cast("string"), "event_type").alias("sym"), F.col("value").alias("price"), F.lit(1).cast("long").alias("quantity"),
        F.col("event_id").alias("tick_id"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return ticks.sessions(rows, "2 hours").withColumns({c: text(c) for c in ("start", "finish")})
