"""Registration of the runnable queries: each has a Spark function and, where SQL can express
it, an ANSI-SQL twin. One output specification serves both sides, so their columns agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.trades import bars_from_trades, by_symbol, densify, with_reference


class Tables:
    """The given tables as DataFrames and the bar views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def trades(self, by: str = "supplier") -> DataFrame:
        df = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_returnflag", F.col("l_shipdate").cast("date").alias("d"))
        if by == "supplier":
            return df.withColumn("sym", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sym"))
        return df.join(part, "l_partkey")

    def bars(self, by: str = "supplier", windows: bool = True) -> DataFrame:
        """``windows``: whether they go on to windows per symbol, which then find large tables dealt over enough parts."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        raw = bars_from_trades(
            self.trades(by), price, F.col("l_quantity"), F.col("l_extendedprice"),
            ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), F.col("l_returnflag"))
        raw = raw.withColumn("shares", self.shares(by))
        if windows and by == "supplier":  # a few brands make few bars
            raw = by_symbol(raw, self.table("lineitem").count())
        # A synthetic 2:1 split on the first of each month exercises the price adjustment.
        return with_reference(raw, F.when(F.dayofmonth("d") == 1, 0.5).otherwise(1.0))

    @staticmethod
    def shares(by: str) -> Column:
        if by == "supplier":
            return (F.lit(1_000_000) + 1000 * F.substring("sym", 2, 20).cast("long")).cast("long")
        return F.lit(1 << 20).cast("long")

    def brand_bars(self) -> DataFrame:
        return self.bars("brand")

    def dense_bars(self) -> DataFrame:
        return densify(self.bars())

    def master(self) -> DataFrame:
        """Security master: suppliers, with their region as listing board."""
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sym"),
                    F.col("s_name").alias("name"), F.col("r_name").alias("board"),
                    F.col("n_name").alias("sector"))
        )


TRADES_SQL = """tr AS (SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS sym, CAST(l_shipdate AS DATE) AS d,
  l_extendedprice / l_quantity AS px, l_quantity, l_extendedprice, l_returnflag,
  l_orderkey, l_linenumber, l_partkey FROM lineitem)"""
TRADES_BRAND_SQL = """tr AS (SELECT p_brand AS sym, CAST(l_shipdate AS DATE) AS d,
  l_extendedprice / l_quantity AS px, l_quantity, l_extendedprice, l_returnflag,
  l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN part ON p_partkey = l_partkey)"""
BARS_SQL = """numbered AS (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY sym, d ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ra,
  ROW_NUMBER() OVER (PARTITION BY sym, d ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rz
  FROM tr),
raw_bars AS (SELECT sym, d, MAX(CASE WHEN ra = 1 THEN px END) AS open, MAX(px) AS high, MIN(px) AS low,
  MAX(CASE WHEN rz = 1 THEN px END) AS close, CAST(SUM(l_quantity) AS BIGINT) AS volume,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, COUNT(*) AS freq,
  SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS fbuy,
  SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS fsell FROM numbered GROUP BY sym, d),
ref_bars AS (SELECT *, {shares} AS shares,
  LAG(close) OVER (PARTITION BY sym ORDER BY d) * CASE WHEN day(d) = 1 THEN 0.5 ELSE 1.0 END AS prev FROM raw_bars),
bars AS (SELECT *, close - prev AS change, ROW_NUMBER() OVER (PARTITION BY sym ORDER BY d) AS rn FROM ref_bars)"""
B1 = TRADES_SQL + ",\n" + BARS_SQL.format(shares="CAST(1000000 + 1000 * CAST(substr(sym, 2) AS BIGINT) AS BIGINT)")
B3 = TRADES_BRAND_SQL + ",\n" + BARS_SQL.format(shares="CAST(1048576 AS BIGINT)")
CALENDAR = """cal AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS s FROM (SELECT DISTINCT d FROM bars))"""
B2 = B1 + ",\n" + CALENDAR + """,
grid AS (SELECT f.sym, c.d, c.s FROM (SELECT sym, MIN(d) AS d0 FROM bars GROUP BY sym) f JOIN cal c ON c.d >= f.d0),
filled AS (SELECT g.sym, g.d, g.s, b.rn IS NOT NULL AS is_real, b.open, b.high, b.low, b.volume, b.value, b.freq,
  b.fbuy, b.fsell, b.prev, b.change,
  LAST_VALUE(b.close IGNORE NULLS) OVER w AS close, LAST_VALUE(b.shares IGNORE NULLS) OVER w AS shares
  FROM grid g LEFT JOIN bars b ON b.sym = g.sym AND b.d = g.d
  WINDOW w AS (PARTITION BY g.sym ORDER BY g.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dense AS (SELECT sym, d, s, close, shares,
  CASE WHEN is_real THEN open ELSE 0.0 END AS open, CASE WHEN is_real THEN high ELSE 0.0 END AS high,
  CASE WHEN is_real THEN low ELSE 0.0 END AS low, CASE WHEN is_real THEN volume ELSE 0 END AS volume,
  CASE WHEN is_real THEN value ELSE 0.0 END AS value, CASE WHEN is_real THEN freq ELSE 0 END AS freq,
  CASE WHEN is_real THEN fbuy ELSE 0.0 END AS fbuy, CASE WHEN is_real THEN fsell ELSE 0.0 END AS fsell,
  CASE WHEN is_real THEN prev ELSE close END AS prev, CASE WHEN is_real THEN change ELSE 0.0 END AS change,
  ROW_NUMBER() OVER (PARTITION BY sym ORDER BY d) AS rn FROM filled)"""
MASTER = """master AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS sym, s_name AS name, r_name AS board, n_name AS sector
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""
W = "OVER (PARTITION BY sym ORDER BY d)"


def over(lo: int | str, hi: int | str = 0, by: str = "sym", order: str = "d") -> str:
    """Window text: frame bounds count rows, negative before the current row."""
    def bound(x: int | str) -> str:
        if isinstance(x, str):
            return {"-": "UNBOUNDED PRECEDING", "+": "UNBOUNDED FOLLOWING"}[x]
        return "CURRENT ROW" if x == 0 else f"{-x} PRECEDING" if x < 0 else f"{x} FOLLOWING"
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {bound(lo)} AND {bound(hi)})"


# Prices are multiples of a cent divided by small integers, so exact halves are common. The two
# engines resolve a half that carries a last-bit error differently; a fixed offset far above such
# errors and far below the printed digit keeps halves off the edge on both sides.
NUDGE = 1.37e-3


def _parts(spec: str) -> list[tuple[str, str]]:
    return [(p.partition(":")[0], p.partition(":")[2]) for p in spec.split()]


# Queries that print prices, shares and ranks only, and ``features_all_columns``, which has no SQL twin. Numbers of ten digits and more are exact halves too often once scaled, and
# go through decimals: 21 of 2,133,892 values of ``price_impact_20`` were off the SQL with ``rounded``, 9 with ``round``.
SMALL = frozenset(("forward_labels_dense", "forward_labels_sparse", "universe_every_date", "cross_section_ranks", "anomaly_proxies",
                   "breadth_score", "max_drawdown_60", "sample_volatility", "eod_panel", "features_all_columns"))


def rounded(x: Column, digits: int) -> Column:
    """Scaled, rounded to a whole number and scaled back, as the SQL engine does. ``round`` writes every number as text and reads
    it back as a decimal. Kept this short on purpose: with a branch the generated method of a wide query passes the 8000 bytes up
    to which the JVM compiles it. Halves (here to even) are kept off by ``NUDGE``; adding zero turns -0.0 into 0.0."""
    return F.rint(x.cast("double") * 10.0 ** digits) / 10.0 ** digits + 0.0


def present(df: DataFrame, spec: str, small: bool = False) -> DataFrame:
    """Select and format the columns of a specification such as ``sym d:date close:4 up:int``."""
    out: list[Column] = []
    for name, kind in _parts(spec):
        c = F.col(name)
        if kind == "date":
            c = c.cast("date").cast("string")
        elif kind == "int":
            c = c.cast("long")
        elif kind == "arr":
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind:
            c = c + NUDGE * 10 ** -int(kind)
            c = rounded(c, int(kind)) if small else F.round(c, int(kind))
        out.append(c.alias(name))
    return df.select(*out)


def present_sql(spec: str) -> str:
    out = []
    for name, kind in _parts(spec):
        if kind == "date":
            x = f"CAST(CAST({name} AS DATE) AS VARCHAR)"
        elif kind == "int":
            x = f"CAST({name} AS BIGINT)"
        elif kind == "arr":
            x = f"array_to_string({name}, '|')"
        elif kind:
            r = f"ROUND(CAST({name} AS DOUBLE) + {NUDGE * 10 ** -int(kind):.3e}, {kind})"
            x = f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END"
        else:
            x = name
        out.append(f"{x} AS {name}")
    return ", ".join(out)


@dataclass(frozen=True)
class Query:
    name: str
    spec: str
    build: Callable[[Tables], DataFrame]
    ctes: str | None
    covers: str

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return present(self.build(Tables(spark, folder)), self.spec, self.name in SMALL)

    def sql(self) -> str | None:
        if self.ctes is None:
            return None
        return f"WITH {self.ctes}\nSELECT {present_sql(self.spec)} FROM q"


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, spec: str, ctes: str | None = None):
    """Register a builder under a name. ``ctes`` ends with a CTE called q that has the same columns."""
    def wrap(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, spec, build, ctes, covers)
        return build
    return wrap
