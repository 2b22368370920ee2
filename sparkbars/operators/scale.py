"""Exact order statistics over groups of any size.

A cross-section (all symbols of one date, all predictions of one run) grows with the data, so no
window may hold one whole. Values are first collapsed to (group, value, count) - which also turns
any number of ties into one row - then placed in ordered buckets by a fixed monotone function of
the value. Only the bucket totals of a group meet in one window (their number is bounded by the
resolution); everything else happens inside a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 4096.0  # buckets per factor e; neighbours in one bucket differ by 0.02%
OFFSET = 3_000_000   # above PER_OCTAVE * 710, the exponent range of doubles


COARSE = 64.0        # the same where rows themselves meet in a bucket: neighbours within 1.6%


def bucket(v: Column, per_octave: float = PER_OCTAVE) -> Column:
    """Monotone bucket number of a double: logarithmic on both sides of zero."""
    size = F.floor(F.log(F.abs(v)) * per_octave) + OFFSET
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def cumulate(df: DataFrame, group: Sequence[str], value: str, sums: dict[str, Column],
             descending: bool = False) -> DataFrame:
    """Per distinct (group, value): each total, the running total before it (``<name>_before``)
    and the group total (``<name>_all``), ordered by value. Rows without a finite value are left out."""
    names = list(sums)
    v = F.col(value).cast("double") + F.lit(0.0)
    per_value = (
        df.filter(F.abs(v) < F.lit(float("inf")))  # neither NULL nor NaN (which is above infinity) nor infinite
        .withColumn(value, v)
        .groupBy(*group, value)
        .agg(*[expr.alias(name) for name, expr in sums.items()])
        .withColumn("_b", bucket(F.col(value)) * (-1 if descending else 1))
    )
    totals = per_value.groupBy(*group, "_b").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    across = Window.partitionBy(*group).orderBy("_b")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = totals.select(
        *group, "_b",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}_start") for n in names],
        *[F.sum(f"_{n}").over(whole).alias(f"{n}_all") for n in names],
    )
    order = F.desc(value) if descending else F.asc(value)
    inside = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = per_value.withColumns({
        f"_{n}_in": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in names
    })
    joined = within.join(starts, [*group, "_b"])
    return joined.select(
        *group, value, *names,
        *[(F.col(f"_{n}_start") + F.col(f"_{n}_in")).alias(f"{n}_before") for n in names],
        *[f"{n}_all" for n in names],
    )


def value_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: ``ties``, ``rank`` (least, 1-based) and group size ``n``."""
    c = cumulate(df, group, value, {"ties": F.count(F.lit(1))})
    return c.select(*group, value, "ties", (F.col("ties_before") + 1).alias("rank"), F.col("ties_all").alias("n"))


def with_all_ranks(df: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every row with ``rank_<value>`` (least, 1-based), ``ties_<value>`` and ``n_<value>`` of its value in its group; NULL where
    the value is not a finite number. Values become doubles. A row meets only those of its group in the same coarse bucket,
    once for each value; where the buckets start is counted for all values in one pass, and that table is bounded by the
    groups and the resolution. The bucket number names the value as well, so one table serves all joins."""
    count = len(values)
    df = df.withColumns({v: F.col(v).cast("double") + F.lit(0.0) for v in values})
    known = {v: F.abs(v) < F.lit(float("inf")) for v in values}
    keys = {v: F.when(known[v], bucket(F.col(v), COARSE) * count + i) for i, v in enumerate(values)}
    totals = (df.select(*group, F.explode(F.array_compact(F.array(*keys.values()))).alias("_b"))
              .groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n")))
    whole = Window.partitionBy(*group, F.pmod("_b", F.lit(count)))
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_all"))
    for v in values:
        rows = df.withColumn("_b", keys[v])
        inside = Window.partitionBy(*group, "_b")
        rows = rows.withColumns({f"rank_{v}": F.rank().over(inside.orderBy(v)), f"ties_{v}": F.count(F.lit(1)).over(Window.partitionBy(*group, "_b", v))})
        rows = rows.join(starts, [*group, "_b"], "left")
        placed = F.col("_start").isNotNull()
        df = rows.withColumns({
            f"rank_{v}": F.col("_start") + F.col(f"rank_{v}"), f"ties_{v}": F.when(placed, F.col(f"ties_{v}")), f"n_{v}": F.col("_all"),
        }).drop("_b", "_start", "_all")
    return df


def with_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Every row with ``rank``, ``ties`` and ``n`` of its value; rows without a finite value keep NULL ranks."""
    ranked = with_all_ranks(df, group, [value])
    return ranked.withColumnsRenamed({f"{k}_{value}": k for k in ("rank", "ties", "n")})


def group_quantiles(df: DataFrame, group: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group without holding a group in one place: coarse buckets are counted first, then only
    the values of the buckets that a quantile falls into are looked at. These are two a group and quantile, so their names
    are sent to every task."""
    v = F.col(value).cast("double") + F.lit(0.0)
    rows = df.filter(F.abs(v) < F.lit(float("inf"))).select(*group, v.alias("_v"), bucket(v, COARSE).alias("_b"))
    totals = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_b", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_all"))
    places = {f"_{name}_{side}": edge((F.col("_all") - 1) * F.lit(q) + 1) for name, q in qs.items() for side, edge in (("lo", F.floor), ("hi", F.ceil))}
    hit = F.lit(False)
    for k in places.values():
        hit = hit | ((k > F.col("_start")) & (k <= F.col("_start") + F.col("_n")))
    wanted = starts.filter(hit).drop("_n")
    values = rows.join(F.broadcast(wanted), [*group, "_b"]).groupBy(*group, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_ties"), F.first("_start").alias("_start"), F.first("_all").alias("_all"))
    last = F.col("_start") + F.sum("_ties").over(Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("_last", last)
    out = values.groupBy(*group).agg(F.max("_all").alias("_all"), *[
        F.max(F.when((F.col("_last") - F.col("_ties") < k) & (k <= F.col("_last")), F.col("_v"))).alias(name) for name, k in places.items()])
    for name, q in qs.items():
        frac = (F.col("_all") - 1) * F.lit(q) % 1
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * frac)
    return out.select(*group, *qs)


def group_places(df: DataFrame, group: Sequence[str], wanted: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """One row per group with exact order statistics of several values in two passes over the rows, for groups that are few (dates).
    ``wanted`` maps a new column to a value and its place, 1-based from below, given the number n of its finite values; between
    two places it is interpolated. As in ``group_quantiles``, coarse buckets are counted first and then only those that a
    place falls into are looked at; here one count serves all values, as the bucket number names the value as well. Groups
    meet by null-safe equality, which leaves the rows' own plan as it is in every pass, so what makes them is exchanged once."""
    values = list(dict.fromkeys(value for value, _ in wanted.values()))
    count = len(values)

    def entry(i: int) -> Column:
        v = F.col(values[i]).cast("double") + F.lit(0.0)
        return F.when(F.abs(v) < F.lit(float("inf")), F.struct((bucket(v, COARSE) * count + i).alias("_b"), v.alias("_v")))

    rows = df.select(*group, F.explode(F.array_compact(F.array(*[entry(i) for i in range(count)]))).alias("_e")).select(*group, "_e._b", "_e._v")
    whole = Window.partitionBy(*group, F.pmod("_b", F.lit(count)))
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_start": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(whole), "_of": F.pmod("_b", F.lit(count))})
    of = {name: F.col("_of") == values.index(value) for name, (value, _) in wanted.items()}
    places = {(name, side): edge(place(F.col("_all"))) for name, (_, place) in wanted.items() for side, edge in (("lo", F.floor), ("hi", F.ceil))}
    hit = F.lit(False)
    for (name, _), k in places.items():
        hit = hit | (of[name] & (k > F.col("_start")) & (k <= F.col("_start") + F.col("_n")))
    names = starts.filter(hit).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_b").alias("_at"), "_start", "_all", "_of")
    same = F.col("_b").eqNullSafe(F.col("_at"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    met = rows.join(F.broadcast(names), same).groupBy(*group, "_b", "_v").agg(
        F.count(F.lit(1)).alias("_ties"), *[F.first(c).alias(c) for c in ("_start", "_all", "_of")])
    upto = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_last", F.col("_start") + F.sum("_ties").over(upto))
    here = lambda k: (F.col("_last") - F.col("_ties") < k) & (k <= F.col("_last"))
    out = met.groupBy(*group).agg(
        *[F.max(F.when(of[name] & here(k), F.col("_v"))).alias(f"_{name}_{side}") for (name, side), k in places.items()],
        *[F.max(F.when(of[name], place(F.col("_all")) % 1)).alias(f"_{name}_part") for name, (_, place) in wanted.items()])
    between = {n: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part") for n in wanted}
    return out.select(*group, *[x.alias(n) for n, x in between.items()])


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows per group and task before the
    exchange (window group limit), so a huge group costs no more than many small ones."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_n(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k best rows overall, numbered. The limit runs in every task before the final merge."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def numbered(df: DataFrame, value: str, then: Sequence[Column], rank: str = "rank") -> DataFrame:
    """All rows with their place by falling value (none and NaN last), equals by ``then``. A window holds the rows of one
    value, and another the number of rows of each value bucket; no task meets all rows."""
    v = F.col(value).cast("double") + F.lit(0.0)
    known = v.isNotNull() & ~F.isnan(v)
    infinite = F.when(v > 0, F.lit(2 * OFFSET)).otherwise(F.lit(-2 * OFFSET))
    rows = df.withColumns({"_v": F.when(known, v), "_b": F.when(known, F.when(F.abs(v) == F.lit(float("inf")), infinite).otherwise(bucket(v)))})
    per_value = rows.groupBy("_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    totals = per_value.groupBy("_b").agg(F.sum("_n").alias("_n"))
    higher = Window.orderBy(F.desc_nulls_last("_b")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_b").alias("_of"), F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    before = per_value.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    before = before.join(starts, F.col("_b").eqNullSafe(F.col("_of"))).select(F.col("_v").alias("_at"), (F.col("_start") + F.col("_in")).alias("_before"))
    own = Window.partitionBy("_v").orderBy(*then)
    met = rows.withColumn("_k", F.row_number().over(own)).join(before, F.col("_v").eqNullSafe(F.col("_at")))
    return met.select(*df.columns, (F.col("_before") + F.col("_k")).cast("int").alias(rank))
