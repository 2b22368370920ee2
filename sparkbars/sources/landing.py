"""Landed files to canonical rows: CSV with header aliases, JSON snapshots, tolerant payloads, a
ledger of files already read."""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..schema import BARS, INDEX_BARS

# Header names accepted per bar column (compared without case, spaces and underscores).
BAR_ALIASES: dict[str, tuple[str, ...]] = {
    "d": ("tanggal", "date", "trading date", "trade date"),
    "sym": ("kode saham", "stock code", "code", "ticker", "symbol"),
    "name": ("nama perusahaan", "stock name", "company name", "company", "name"),
    "remarks": ("remarks",),
    "prev": ("sebelumnya", "previous", "prev", "previous price"),
    "open": ("open price", "opening price", "harga pembukaan", "open"),
    "first": ("first trade", "first", "perdagangan pertama"),
    "high": ("tertinggi", "high", "highest", "harga tertinggi"),
    "low": ("terendah", "low", "lowest", "harga terendah"),
    "close": ("penutupan", "close", "closing price", "harga penutupan"),
    "change": ("selisih", "change", "perubahan"),
    "volume": ("volume",),
    "value": ("nilai", "value", "trading value", "nilai transaksi"),
    "freq": ("frekuensi", "frequency", "freq"),
    "index_indiv": ("individual index", "indeks individual"),
    "offer": ("offer", "ask", "penawaran jual"),
    "offer_vol": ("offer volume", "ask volume", "volume penawaran jual"),
    "bid": ("bid", "penawaran beli"),
    "bid_vol": ("bid volume", "volume penawaran beli"),
    "shares": ("listed shares", "saham tercatat"),
    "tradable": ("tradeable shares", "tradable shares", "saham dapat diperdagangkan"),
    "index_weight": ("index weight", "bobot indeks"),
    "fsell": ("foreign sell", "jual asing"),
    "fbuy": ("foreign buy", "beli asing"),
    "delisted": ("delisting date", "tanggal delisting"),
    "nr_volume": ("non regular volume", "volume non reguler"),
    "nr_value": ("non regular value", "nilai non reguler"),
    "nr_freq": ("non regular frequency", "frekuensi non reguler"),
}


def _plain(name: str) -> str:
    return re.sub(r"[\s_]+", "", name.strip().lower())


def map_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]] = BAR_ALIASES) -> DataFrame:
    """Text columns under canonical names; optional ones that are missing become NULL, date and symbol
    are mandatory."""
    known = {_plain(c): c for c in df.columns}
    found = {name: next((known[_plain(a)] for a in (*names, name) if _plain(a) in known), None) for name, names in aliases.items()}
    missing = [k for k in ("d", "sym") if found.get(k) is None]
    if missing:
        raise ValueError(f"mandatory columns not found: {missing}")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(*[(quoted(c).cast("string") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()])


def typed_bars(texts: DataFrame) -> DataFrame:
    """Canonical bar types; rows without a readable date or symbol are dropped."""
    out: list[Column] = []
    for field in BARS.fields:
        c = field.name
        if c not in texts.columns:
            out.append(F.lit(None).cast(field.dataType).alias(c))
        elif isinstance(field.dataType, T.DateType):
            out.append(parse_date(c).alias(c))
        elif isinstance(field.dataType, (T.DoubleType, T.LongType)):
            out.append(parse_number(c, isinstance(field.dataType, T.LongType)).alias(c))
        elif c == "sym":
            out.append(F.upper(F.trim(c)).alias(c))
        else:
            out.append(F.col(c).cast(field.dataType).alias(c))
    df = texts.select(*out)
    return df.filter(F.col("d").isNotNull() & (F.col("sym") != "") & (F.col("sym") != "NAN"))


SEPARATORS = (",", ";", "\t", "|")


def separator_of(header: str) -> str:
    """The separator that cuts a header line, outside of quotes, into the most names."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(SEPARATORS, key=bare.count)


@dataclass(frozen=True)
class Layout:
    """How a group of files is read: the separator, and what stands at each place (None: nothing of ours)."""

    sep: str
    places: tuple[str | None, ...]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(name or f"_unused_{i}", T.StringType()) for i, name in enumerate(self.places)])


def layout_of(header: str, aliases: Mapping[str, Sequence[str]] = BAR_ALIASES, sep: str | None = None) -> Layout:
    """The layout a header line tells. Of several spellings of one column the first accepted one counts; a column's
    canonical name is accepted last; date and symbol are mandatory."""
    header = header.removeprefix("\ufeff").rstrip("\r")
    sep = sep or separator_of(header)
    names = [_plain(c) for c in next(csv.reader([header], delimiter=sep), [])]
    places: list[str | None] = [None] * len(names)
    for name, spellings in aliases.items():
        at = next((names.index(_plain(a)) for a in (*spellings, name) if _plain(a) in names), None)
        if at is not None and places[at] is None:
            places[at] = name
    missing = [k for k in ("d", "sym") if k not in places]
    if missing:
        raise ValueError(f"mandatory columns not found: {missing}")
    return Layout(sep, tuple(places))


def _first_of_each_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows at which the first column changes."""
    last = None
    for batch in batches:
        if batch.num_rows:
            paths = batch.column(0)
            changed = pc.not_equal(paths.slice(1), paths.slice(0, batch.num_rows - 1)).to_pylist()
            yield batch.take(pa.array([i for i, c in enumerate([paths[0].as_py() != last, *changed]) if c], pa.int64()))
            last = paths[-1].as_py()


def headers(spark: SparkSession, path: str) -> DataFrame:
    """``(path, header)``: the first line of every file that has one. A file's first block is read by one task in
    order and the next file after it, so first lines stand where the path changes; no task holds or sorts the lines."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("header"), F.col("_metadata.file_block_start").alias("block"))
    return lines.where("block = 0").drop("block").mapInArrow(_first_of_each_path, "path string, header string")


def read_bars(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]] = BAR_ALIASES, sep: str | None = None,
              max_layouts: int = 1000) -> DataFrame:
    """Bars of a folder of CSV files, each with its own accepted header, column order and separator.

    A first pass reads the header lines; files of one layout are then read together by place, and all layouts are united
    by name. The driver sees one line per file, as it does when it lists them. A file without a mandatory column
    stops the import and is named, rather than being left out; files without any line hold no rows. Optional columns
    that a layout lacks are NULL there, columns of no known name are ignored.
    """
    files: dict[Layout, list[str]] = {}
    for row in headers(spark, path).collect():
        try:
            layout = layout_of(row.header, aliases, sep)
        except ValueError as e:
            raise ValueError(f"{row.path}: {e}") from None
        files.setdefault(layout, []).append(unquote(row.path))
        if len(files) > max_layouts:
            raise ValueError(f"more than {max_layouts} layouts in {path}")
    out = None
    for layout in sorted(files, key=lambda x: (x.sep, tuple(n or "" for n in x.places))):
        rows = spark.read.schema(layout.schema()).csv(sorted(files[layout]), header=True, sep=layout.sep, enforceSchema=True)
        rows = rows.select(*[n for n in layout.places if n])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in ("d", "sym")]))
    return typed_bars(out)


# Snapshot field of each bar column.
SNAPSHOT_FIELDS = {
    "name": "StockName", "prev": "Previous", "open": "OpenPrice", "first": "FirstTrade", "high": "High", "low": "Low", "close": "Close",
    "change": "Change", "volume": "Volume", "value": "Value", "freq": "Frequency", "offer": "Offer", "offer_vol": "OfferVolume", "bid": "Bid",
    "bid_vol": "BidVolume", "shares": "ListedShares", "tradable": "TradebleShares", "index_indiv": "IndexIndividual", "index_weight": "WeightForIndex",
    "fsell": "ForeignSell", "fbuy": "ForeignBuy", "delisted": "DelistingDate", "nr_volume": "NonRegularVolume", "nr_value": "NonRegularValue",
    "nr_freq": "NonRegularFrequency", "remarks": "Remarks", "ext_id": "IDStockSummary",
}
INDEX_FIELDS = {
    "prev": "Previous", "high": "Highest", "low": "Lowest", "close": "Close", "change": "Change", "volume": "Volume", "value": "Value", "freq": "Frequency",
    "stocks": "NumberOfStock", "market_cap": "MarketCapital",
}


def _payload_schema(names: Sequence[str]) -> T.StructType:
    item = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return T.StructType([T.StructField("recordsTotal", T.LongType()), T.StructField("data", T.ArrayType(item))])


def _parse(raw: DataFrame, schema: T.StructType, code: str, fields: Mapping[str, str], target: T.StructType, key: str) -> DataFrame:
    names = ["Date", code, *fields.values()]
    rows = raw.withColumn("_p", F.from_json("payload", _payload_schema(names)))
    rows = rows.select("day", F.col("_p.recordsTotal").alias("declared"), F.size("_p.data").alias("received"), F.explode("_p.data").alias("r"))
    types = {f.name: f.dataType for f in target.fields}
    d = F.substring(F.col("r.Date"), 1, 10).try_cast("date")
    text = lambda c: F.nullif(F.trim(F.col(f"r.{c}")), F.lit(""))

    def value(name: str, source: str) -> Column:
        kind = types[name]
        if isinstance(kind, T.LongType):
            return text(source).try_cast("double").cast("long")
        return F.substring(text(source), 1, 10).try_cast("date") if isinstance(kind, T.DateType) else text(source).try_cast(kind)

    out = rows.select("day", "declared", "received", d.alias("d"), F.upper(F.trim(F.col(f"r.{code}"))).alias(key),
                      *[value(n, s).alias(n) for n, s in fields.items()])
    return out.filter((F.col(key) != "") & F.col(key).isNotNull() & (F.coalesce(F.col("d"), F.col("day")) == F.col("day"))).withColumn("d", F.col("day"))


def parse_snapshot(raw: DataFrame) -> DataFrame:
    """``day, payload`` JSON texts to bar rows; a record dated otherwise than its day is dropped."""
    return _parse(raw, BARS, "StockCode", SNAPSHOT_FIELDS, BARS, "sym")


def parse_index_snapshot(raw: DataFrame) -> DataFrame:
    return _parse(raw, INDEX_BARS, "IndexCode", INDEX_FIELDS, INDEX_BARS, "index_code")


# Keys under which a payload may carry its records.
RECORD_KEYS = ("data", "Data", "results", "Results", "result", "Result", "aaData", "items", "Items")


def _record_list(value) -> list[dict]:
    """Depth-first, with a stack of its own since nesting is unbounded: a list's objects; of an object, first what its
    record keys hold, then any other value. A list under a record key ends the search even if it holds no object."""
    stack = [(value, False)]
    while stack:
        value, keyed = stack.pop()
        if isinstance(value, list):
            found = [x for x in value if isinstance(x, dict)]
            if found or keyed:
                return found
        elif isinstance(value, dict):
            inner = [(value[key], True) for key in RECORD_KEYS if key in value] + [(v, False) for k, v in value.items() if k not in RECORD_KEYS]
            stack += reversed(inner)
    return []


def _records_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def records(text):
        try:
            return [json.dumps(r, ensure_ascii=False) for r in _record_list(json.loads(text))] if text else []
        except ValueError:
            return []
        except RecursionError:
            raise ValueError("a payload is nested deeper than the JSON parser goes") from None
    for batch in texts:
        yield batch.map(records)


def extract_records(raw: DataFrame) -> DataFrame:
    """One row per record (a JSON text) of tolerant payloads, at any depth and under any key: the payload itself when
    it is a list, else the list that a depth-first search meets first, record keys before others.

    Nesting is unbounded, which column functions cannot walk: texts go through Arrow in batches. A text that is no
    JSON has no records; one that nests beyond the parser (thousands of levels) stops the job rather than being lost.
    """
    walk = F.pandas_udf(_records_of, "array<string>")
    return raw.withColumn("record", F.explode(walk("payload")))


def pick(record: Column, aliases: Sequence[str], parsed: bool = False) -> Column:
    """The first non-empty value among aliases of a JSON record, whatever their case."""
    fields = record if parsed else F.from_json(record, "map<string,string>")
    lowered = F.transform_keys(fields, lambda k, v: F.lower(F.trim(k)))
    return F.coalesce(*[F.nullif(F.element_at(lowered, a.lower()), F.lit("")) for a in aliases])


def ingest_files(spark: SparkSession, path: str, ledger: DataFrame | None) -> DataFrame:
    """Files whose content hash the ledger does not know yet: path, hash, size and text. Only (hash, path) pairs are
    shuffled to find them; bodies are read again for the files that remain."""
    files = spark.read.format("binaryFile").load(path)
    names = files.select("path", F.sha2("content", 256).alias("sha256")).groupBy("sha256").agg(F.min("path").alias("path"))
    fresh = names if ledger is None else names.join(ledger.select("sha256").distinct(), "sha256", "left_anti")
    return files.join(fresh, "path").select("path", "sha256", "length", F.decode("content", "UTF-8").alias("payload"))


def changed_payloads(new: DataFrame, key: str = "source", order: str = "fetched_at", payload: str = "payload", stretch: int = 10_000) -> DataFrame:
    """Each fetch with its hash and whether it differs from the fetch before it.

    A source may hold most of the rows, so each is cut into stretches of its (whole-numbered) order: inside a stretch
    the row before decides, and the first row of a stretch looks at the last row of the stretch before."""
    df = new.withColumns({"sha256": F.sha2(payload, 256), "_stretch": F.floor(F.col(order) / stretch)})
    lasts = df.groupBy(key, "_stretch").agg(F.max_by("sha256", order).alias("_last"))
    borders = lasts.withColumn("_border", F.lag("_last").over(Window.partitionBy(key).orderBy("_stretch"))).drop("_last")
    inside = Window.partitionBy(key, "_stretch").orderBy(order)
    df = df.withColumns({"_before": F.lag("sha256").over(inside), "_first": F.row_number().over(inside) == 1}).join(borders, [key, "_stretch"])
    before = F.when(F.col("_first"), F.col("_border")).otherwise(F.col("_before"))
    return df.withColumn("status", F.when(before == F.col("sha256"), "no_change").otherwise("changed")).drop("_stretch", "_before", "_first", "_border")
