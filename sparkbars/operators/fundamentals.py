"""Statements to period windows, valuation, projection, growth and value screens.

Statements have ``sym, period_type, period_end, year, quarter, revenue, net_income, equity``;
one symbol has four quarters and one annual row a year, which bounds every group here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof_join

# Label, kind, quarters summed, factor that annualises.
PERIODS = (
    ("Q1", "quarterly", (1,), 4.0), ("Q2", "quarterly", (2,), 4.0), ("Q3", "quarterly", (3,), 4.0), ("Q4", "quarterly", (4,), 4.0),
    ("H1", "semester", (1, 2), 2.0), ("9M", "nine_month", (1, 2, 3), 4.0 / 3.0),
)


def period_windows(fin: DataFrame) -> DataFrame:
    """Cumulative windows per symbol and year: quarters, half year, nine months, full year (as
    reported, else the four quarters). A window exists when all its quarters do; a missing part
    makes its sum NULL."""
    kind = F.col("period_type")
    aggs: list[Column] = []
    for q in (1, 2, 3, 4):
        pick = (kind == "quarterly") & (F.col("quarter") == q)
        aggs.append(F.max(F.when(pick, F.struct("period_end", "net_income", "revenue", "equity"))).alias(f"q{q}"))
    aggs.append(F.max(F.when(kind == "annual", F.struct("period_end", "net_income", "revenue", "equity"))).alias("y"))
    per = fin.groupBy("sym", "year").agg(*aggs)

    def window(label: Column, name: str, last: str, ni: Column, rev: Column, factor: float, exists: Column) -> Column:
        return F.when(exists, F.struct(
            F.lit(name).alias("kind"), label.alias("label"), F.col(f"{last}.period_end").alias("period_end"),
            ni.alias("net_income"), rev.alias("revenue"), F.col(f"{last}.equity").alias("equity"), F.lit(factor).alias("factor")))

    def total(quarters: tuple[int, ...], field: str) -> Column:
        out = F.col(f"q{quarters[0]}.{field}")
        for q in quarters[1:]:
            out = out + F.col(f"q{q}.{field}")
        return out

    year = F.col("year").cast("string")
    items = []
    for label, name, quarters, factor in PERIODS:
        exists = F.col(f"q{quarters[0]}").isNotNull()
        for q in quarters[1:]:
            exists = exists & F.col(f"q{q}").isNotNull()
        items.append(window(F.concat(year, F.lit(f"-{label}")), name, f"q{quarters[-1]}",
                            total(quarters, "net_income"), total(quarters, "revenue"), factor, exists))
    whole = (1, 2, 3, 4)
    all_four = F.col("q1").isNotNull() & F.col("q2").isNotNull() & F.col("q3").isNotNull() & F.col("q4").isNotNull()
    items.append(window(year, "annual", "y", F.col("y.net_income"), F.col("y.revenue"), 1.0, F.col("y").isNotNull()))
    items.append(window(year, "annual", "q4", total(whole, "net_income"), total(whole, "revenue"), 1.0,
                        F.col("y").isNull() & all_four))
    out = per.select("sym", "year", F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("w"))
    return out.select("sym", "year", "w.*")


def _multiples(df: DataFrame) -> DataFrame:
    price, shares = F.col("price"), F.col("shares")
    eps, bvps = F.col("income_annualised") / shares, F.col("equity") / shares
    per, pbv = price / eps, price / bvps
    return df.withColumns({
        "eps": eps, "bvps": bvps, "market_cap": price * shares,
        "per": F.when((eps > 0) & (F.abs(per) <= 500), per), "pbv": F.when((bvps > 0) & (F.abs(pbv) <= 100), pbv)})


def valuation(windows: DataFrame, bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Price on or before each period end, per-share figures, multiples within plausible bounds."""
    prices = bars.filter(F.col("close") > 0).select("sym", "d", "close")
    df = asof_join(windows, prices, "sym", "period_end", ["close"]).withColumnRenamed("close", "price")
    df = df.join(shares.filter(F.col("shares") > 0), "sym")
    return _multiples(df.withColumn("income_annualised", F.col("net_income") * F.col("factor")))


def project_income(windows: DataFrame, bars: DataFrame, shares: DataFrame) -> DataFrame:
    """Next year's income from the mean growth of annual incomes (growth over positive years only),
    where the last one is positive; valued at the newest close."""
    annual = windows.filter((F.col("kind") == "annual") & F.col("net_income").isNotNull())
    prev = F.lag("net_income").over(Window.partitionBy("sym").orderBy("year"))
    annual = annual.withColumn("_g", F.when(prev > 0, F.col("net_income") / prev - 1))
    per = annual.groupBy("sym").agg(
        F.avg("_g").alias("growth"), F.max("year").alias("last_year"), F.max_by("net_income", "year").alias("last_income"),
        F.max_by("equity", "year").alias("equity"))
    per = per.filter(F.col("growth").isNotNull() & (F.col("last_income") > 0))
    newest = bars.filter(F.col("close") > 0).groupBy("sym").agg(F.max_by("close", "d").alias("price"))
    per = per.join(newest, "sym", "left").join(shares.filter(F.col("shares") > 0), "sym")
    per = per.withColumn("income_annualised", F.col("last_income") * (1 + F.col("growth")))
    per = per.withColumn("label", F.concat((F.col("last_year") + 1).cast("string"), F.lit("-Projection")))
    return _multiples(per)


def growth(fin: DataFrame) -> DataFrame:
    """Growth streaks that end now (annual income and revenue, quarterly income), growth rates from
    first to last period, and a category. A streak is the number of periods after the last one that
    did not grow."""
    long = fin.select("sym", "period_type", "period_end", F.explode(F.array(
        F.struct(F.lit("income").alias("m"), F.col("net_income").alias("x")),
        F.struct(F.lit("revenue").alias("m"), F.col("revenue").alias("x")))).alias("v")
    ).select("sym", "period_type", "period_end", "v.m", "v.x").filter(F.col("x").isNotNull())
    order = Window.partitionBy("sym", "period_type", "m").orderBy("period_end")
    long = long.withColumns({"i": F.row_number().over(order), "_prev": F.lag("x").over(order)})
    per = long.groupBy("sym", "period_type", "m").agg(
        F.max("i").alias("n"),
        F.max(F.when(F.col("_prev").isNull() | (F.col("x") <= F.col("_prev")), F.col("i"))).alias("_stop"),
        F.min_by("x", "i").alias("first"), F.max_by("x", "i").alias("last"), F.max("period_end").alias("latest"))
    rate = F.when((F.col("n") >= 2) & (F.col("first") > 0) & (F.col("last") > 0),
                  (F.pow(F.col("last") / F.col("first"), F.lit(1.0) / (F.col("n") - 1)) - 1) * 100)
    per = per.withColumns({"streak": F.col("n") - F.col("_stop"), "comparisons": F.col("n") - 1, "rate": rate})

    def cell(kind: str, m: str, field: str) -> Column:
        return F.max(F.when((F.col("period_type") == kind) & (F.col("m") == m), F.col(field)))

    out = per.groupBy("sym").agg(
        F.coalesce(cell("annual", "income", "streak"), F.lit(0)).alias("income_streak"),
        F.coalesce(cell("annual", "income", "comparisons"), F.lit(0)).alias("income_comparisons"),
        F.coalesce(cell("annual", "revenue", "streak"), F.lit(0)).alias("revenue_streak"),
        F.coalesce(cell("quarterly", "income", "streak"), F.lit(0)).alias("quarterly_income_streak"),
        cell("annual", "income", "rate").alias("income_cagr_pct"), cell("annual", "revenue", "rate").alias("revenue_cagr_pct"),
        cell("annual", "income", "last").alias("latest_annual_income"),
        cell("annual", "income", "latest").alias("latest_annual_period"), cell("quarterly", "income", "latest").alias("latest_quarterly_period"))
    s, t = F.col("income_streak"), F.col("income_comparisons")
    category = (F.when((t >= 2) & (s == t), "consistent_compounder").when((t >= 1) & (s >= 1), "growing")
                .when((t >= 1) & (s == 0), "declining").otherwise("volatile"))
    enough = fin.groupBy("sym").agg(
        F.count_if(F.col("period_type") == "annual").alias("_a"), F.count_if(F.col("period_type") == "quarterly").alias("_q"))
    enough = enough.filter((F.col("_a") >= 2) | (F.col("_q") >= 2)).select("sym")
    return out.withColumn("category", category).join(enough, "sym", "left_semi")


def valuation_history(values: DataFrame, projection: DataFrame | None = None) -> DataFrame:
    """All windows (and projections) as one listing; ``is_projected`` marks the estimates."""
    cols = ["sym", "kind", "label", "income_annualised", "eps", "bvps", "price", "per", "pbv", "market_cap"]
    out = values.select(*cols).withColumn("is_projected", F.lit(0))
    if projection is not None:
        est = projection.withColumn("kind", F.lit("projection")).select(*cols).withColumn("is_projected", F.lit(1))
        out = out.unionByName(est)
    return out


def quant_screen(fund: DataFrame, positions: DataFrame) -> DataFrame:
    """Overlapping value and quality categories with the price position. Zero ratios count as missing."""
    roe, roa, pbv, der = F.col("roe"), F.col("roa"), F.col("pbv"), F.col("der")
    some = lambda c: c.isNotNull() & (c != 0)
    cats = F.array(
        F.when((roe >= 12) & some(pbv) & (pbv <= 1.5) & (der.isNull() | (der <= 1.5)), "super_value"),
        F.when((roe >= 15) | (roa >= 8), "quality_growth"),
        F.when(some(pbv) & (pbv <= 0.8) & ((roe < 0) | (der > 2.5)), "value_trap"),
        F.when((pbv >= 4.0) & (roe.isNull() | (roe < 5)), "overvalued"))
    found = F.filter(cats, lambda x: x.isNotNull())
    cats = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("neutral")))
    return fund.join(positions, "sym", "left").withColumn("categories", cats)


def category_counts(screened: DataFrame) -> DataFrame:
    return screened.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("symbols"))


def melt_statements(wide: DataFrame, aliases: dict[str, tuple[str, ...]], periods: list[str]) -> DataFrame:
    """Statements with one column per period (rows are items) to one row per period: the first
    available alias of each item; quarter from the month; rows with neither revenue nor income dropped."""
    long = wide.unpivot(["sym", "item"], periods, "period", "x").filter(F.col("x").isNotNull())
    cols = []
    for name, items in aliases.items():
        picks = [F.max(F.when(F.col("item") == i, F.col("x"))) for i in items]
        cols.append(F.coalesce(*picks).alias(name))
    out = long.groupBy("sym", "period").agg(*cols).withColumn("period_end", F.to_date("period"))
    out = out.withColumns({"year": F.year("period_end"), "quarter": F.quarter("period_end")})
    return out.filter(F.col("revenue").isNotNull() | F.col("net_income").isNotNull()).drop("period")
