"""Embedding near-dedup by a flat graph: robust-pruned on overlapping cluster shards, united, searched, audited."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cells, n_parts, stage
from .graph import components


@dataclass(frozen=True)
class Plan:
    """Vectors of one label with cosine >= ``cosine`` are linked.

    A shard of more than ``most`` vectors is split around up to ``pivots`` of its own vectors, at least
    ``apart`` (cosine) from each other; a vector goes to its nearest pivot, its main shard, and to others, ``overlap`` in
    all at most, within ``margin`` degrees of that. A part of more than half of what was split is too dense to
    split on: it is compared in blocks of ``block`` vectors.
    """

    cosine: float = 0.98
    most: int = 2048
    pivots: int = 128
    apart: float = 0.9
    overlap: int = 3
    margin: float = 6.0
    block: int = 2048
    degree: int = 24
    stretch: float = 1.2
    beam: int = 24
    near: float = 0.95  # the search goes on around everything this near
    audited: int = 256
    recall: float = 0.98


def matrix(column: pd.Series) -> np.ndarray:
    """Unit rows in double precision."""
    rows = np.stack(column.to_numpy()).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def robust_prune(sims: np.ndarray, degree: int, stretch: float) -> list[np.ndarray]:
    """Neighbours of each row: the nearest first, leaving out what an accepted neighbour is ``stretch`` times nearer
    to (in squared distance) than the row itself."""
    n = len(sims)
    apart = 1.0 - sims
    np.fill_diagonal(apart, np.inf)
    order = np.argsort(apart, axis=1)[:, :min(n - 1, 3 * degree)] if n > 1 else np.empty((n, 0), int)
    out = []
    for i in range(n):
        pool, chosen = order[i], []
        while len(pool) and len(chosen) < degree:
            best = pool[0]
            chosen.append(best)
            pool = pool[1:]
            pool = pool[stretch * apart[best, pool] > apart[i, pool]]
        out.append(np.array(chosen, np.int64))
    return out


def search(x: np.ndarray, neighbours: list[np.ndarray], query: int, start: int, plan: Plan) -> np.ndarray:
    """Rows found within ``plan.cosine`` of a row: greedily from the medoid with a beam, then on through
    everything near."""
    n = len(x)
    sims, seen, grown = np.full(n, -2.0), np.zeros(n, bool), np.zeros(n, bool)

    def look(at: np.ndarray) -> None:
        at = at[~seen[at]]
        if len(at):
            seen[at] = True
            sims[at] = x[at] @ x[query]

    look(np.unique([start, query]))
    while True:
        known = np.flatnonzero(seen)
        if len(known) > plan.beam:
            known = known[np.argpartition(-sims[known], plan.beam - 1)[:plan.beam]]
        fresh = known[~grown[known]]
        if not len(fresh):
            fresh = np.flatnonzero(seen & ~grown & (sims >= plan.near))
            if not len(fresh):
                break
        grown[fresh] = True
        look(np.unique(np.concatenate([neighbours[i] for i in fresh])) if len(fresh) else fresh)
    found = np.flatnonzero(sims >= plan.cosine)
    return found[found != query]


def _adjacency(plan: Plan):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec"].to_numpy()
        sims = (x := matrix(pdf["embedding"])) @ x.T
        lists = robust_prune(sims.copy(), plan.degree, plan.stretch)
        return pd.DataFrame({"vec": ids, "neighbours": [ids[a].tolist() for a in lists],
                             "close": [ids[a[sims[i, a] >= plan.near]].tolist() for i, a in enumerate(lists)]})
    return run


def roots(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component: labels spread along links and along what they point at."""
    low = np.arange(len(linked))
    linked = linked | linked.T
    busy = np.flatnonzero(linked.any(axis=1))
    part = linked[np.ix_(busy, busy)]
    label = np.arange(len(busy))
    while len(busy):
        spread = np.minimum(label, np.where(part, label[None, :], len(busy)).min(axis=1))
        spread = spread[spread]
        if (spread == label).all():
            break
        label = spread
    low[busy] = busy[label]
    return low


FOUND = "vec bigint, links bigint, low bigint"


def _found(plan: Plan):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Per row of a shard: for its main vectors the copies of the others they are linked to, and for all the smallest
        row they hang together with here. The graph has the shard's vectors and those that other shards' lists
        bring near them."""
        pdf = pdf.sort_values("vec", ignore_index=True)
        ids, copies, main = pdf["vec"].to_numpy(), pdf["copies"].to_numpy(), pdf["main"].to_numpy()
        x, n = matrix(pdf["embedding"]), len(pdf)
        place = {v: i for i, v in enumerate(ids)}
        edges = np.array([(i, place[v]) for i, near in enumerate(pdf["neighbours"]) for v in near if v in place], np.int64).reshape(-1, 2)
        edges = np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)  # edges lead both ways
        lists = np.split(edges[:, 1], np.searchsorted(edges[:, 0], np.arange(1, n)))
        medoid = int((x @ x.mean(axis=0)).argmax())
        linked = np.zeros((n, n), bool)
        for i in np.flatnonzero(main):
            linked[i, search(x, lists, i, medoid, plan)] = True
        linked |= linked.T
        return pd.DataFrame({"vec": ids, "links": np.where(main, linked @ copies, 0), "low": ids[roots(linked)]})
    return run


def _assign(plan: Plan):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Parts of one stretch of a shard: one row per vector and pivot it goes to."""
        columns = ["vec", "copies", "embedding", "shard", "main", "bound"]
        if not len(left):
            return pd.DataFrame({c: [] for c in columns})
        right = right.sort_values("nth")
        p, kept = matrix(right["embedding"]), []
        for i in range(len(p)):
            if not kept or (p[kept] @ p[i]).max() < plan.apart:
                kept.append(i)
        angles = np.degrees(np.arccos(np.clip(matrix(left["embedding"]) @ p[kept].T, -1, 1)))
        order = np.argsort(angles, axis=1, kind="stable")[:, :plan.overlap]
        ranked = np.take_along_axis(angles, order, axis=1)
        rows, cols = np.nonzero(ranked <= ranked[:, :1] + plan.margin)
        out = left[["vec", "copies", "embedding"]].iloc[rows].reset_index(drop=True)
        shard, main = left["shard"].to_numpy()[rows], left["main"].to_numpy()[rows]
        out["shard"] = [f"{s}/{c}" for s, c in zip(shard, order[rows, cols])]
        out["main"], out["bound"] = main & (cols == 0), left["size"].to_numpy()[rows] // 2
        return out[columns]
    return run


def shards(points: DataFrame, plan: Plan) -> tuple[DataFrame | None, DataFrame | None]:
    """``(vec, copies, embedding, shard, main)``: overlapping shards of at most ``plan.most`` vectors, and the dense ones.

    Every vector is main in one shard. Splitting a shard needs its pivots, the first of its own vectors by hash,
    and takes stretches of bounded size, so neither a label nor a cluster ever meets in one task. What is split on is
    at most half as large as what it came from, so there are at most log2(n) rounds; a part that stays larger is dense.
    """
    columns = ["vec", "copies", "embedding", "shard", "main"]
    open_ = points.select("vec", "copies", "embedding", F.concat_ws(":", "label", F.size("embedding")).alias("shard"),
                          F.lit(True).alias("main"), F.lit(None).cast("bigint").alias("bound"))
    done: dict[str, DataFrame] = {}
    while True:
        open_ = stage(open_, "placed")
        sizes = stage(open_.groupBy("shard").agg(F.count("*").alias("size"), F.first("bound").alias("bound")).select(
            "shard", "size", F.when(F.col("size") <= plan.most, "flat").when(F.col("size") > F.col("bound"), "dense").otherwise("split").alias("kind")), "sizes")
        kinds = {r.kind for r in sizes.select("kind").distinct().collect()}
        sized = open_.drop("bound").join(sizes, "shard")
        for kind in kinds - {"split"}:
            part = sized.where(F.col("kind") == kind).select(*columns)
            done[kind] = done[kind].unionByName(part) if kind in done else part
        if "split" not in kinds:
            return done.get("flat"), done.get("dense")
        wide = sized.where("kind = 'split'").drop("kind")
        wanted = F.least(F.lit(plan.pivots), F.ceil(4 * F.col("size") / plan.most) + 1)
        nth = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("vec", F.lit(3)), "vec"))
        pivots = stage(wide.withColumn("nth", nth).where(F.col("nth") <= plan.pivots).where(F.col("nth") <= wanted).select(
            "shard", "nth", "embedding", "size"), "pivots")
        stretches = F.ceil(F.col("size") / 4096).cast("int")
        left = wide.withColumn("salt", F.pmod(F.xxhash64("vec", F.lit(-1)), stretches).cast("int"))
        right = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), stretches - 1))).select("shard", "salt", "nth", "embedding")
        open_ = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(
            _assign(plan), "vec bigint, copies bigint, embedding array<float>, shard string, main boolean, bound bigint")


def _block(plan: Plan):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links of the left rows to the right ones, and what hangs together with what here."""
        if not len(left) or not len(right):
            return pd.DataFrame({"vec": [], "links": [], "low": []}, dtype=np.int64)
        a, b = left["vec"].to_numpy(), right["vec"].to_numpy()
        hit = (matrix(left["embedding"]) @ matrix(right["embedding"]).T >= plan.cosine) & (a[:, None] != b)
        ids = np.union1d(a, b)
        at_a, at_b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        # Each side's smallest partner ties a row to a component; rounds of this tie all of it.
        low = np.arange(len(ids))
        while True:
            before = low.copy()
            np.minimum.at(low, at_a, np.where(hit, low[at_b][None, :], len(ids)).min(axis=1))
            np.minimum.at(low, at_b, np.where(hit, low[at_a][:, None], len(ids)).min(axis=0))
            low = low[low]
            if (low == before).all():
                break
        links = np.zeros(len(ids), np.int64)
        links[at_a] = hit @ right["copies"].to_numpy()
        return pd.DataFrame({"vec": ids, "links": links, "low": ids[low]})
    return run


def block_links(placed: DataFrame, plan: Plan) -> DataFrame:
    """``(vec, links, low)`` of the main rows of shards, each compared with all rows of its shard, block by block: exact
    and quadratic in work, and a row is sent once per block of its shard."""
    rows = placed.select("vec", "copies", "embedding", "shard")
    return cells(placed.where("main").select("vec", "embedding", "shard"), rows, ["shard"], plan.block, plan.block, "vec", "vec").applyInPandas(
        _block(plan), FOUND)


def usable() -> Column:
    """Whether a row can be linked: an id, a label, and finite components that are not all zero."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))


def graph_links(flat: DataFrame, points: DataFrame, plan: Plan) -> DataFrame:
    """``(vec, links, low)`` by searching the united graph: a shard's task holds its vectors, the vectors that lists of
    other shards call near to its main ones, and of all of them the united lists."""
    lists = flat.groupBy("shard").applyInPandas(_adjacency(plan), "vec bigint, neighbours array<bigint>, close array<bigint>")
    united = stage(lists.groupBy("vec").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"),
                                            F.array_distinct(F.flatten(F.collect_list("close"))).alias("close")), "united")
    called = flat.where("main").join(united, "vec").select("shard", F.explode("close").alias("vec")).distinct()
    halo = called.join(flat.select("shard", "vec"), ["shard", "vec"], "left_anti").join(points.select("vec", "copies", "embedding"), "vec").select(
        "vec", "copies", "embedding", "shard", F.lit(False).alias("main"))
    members = flat.unionByName(halo).join(united.select("vec", "neighbours"), "vec")
    return members.repartition(n_parts(points.sparkSession), "shard").groupBy("shard").applyInPandas(_found(plan), FOUND)


def search_links(points: DataFrame, plan: Plan) -> DataFrame:
    """``(vec, links, low)`` rows of all shards: link counts, and edges to local components."""
    flat, dense = shards(points, plan)
    parts = [] if flat is None else [graph_links(stage(flat, "flat"), points, plan)]
    parts += [] if dense is None else [block_links(stage(dense, "dense"), plan)]
    found = parts[0] if parts else points.select("vec", F.lit(0).cast("bigint").alias("links"), F.col("vec").alias("low")).limit(0)
    for part in parts[1:]:
        found = found.unionByName(part)
    return stage(found, "found")


def audit(vectors: DataFrame, counted: DataFrame, plan: Plan) -> float:
    """Recall of the link counts of at most ``plan.audited`` vectors, drawn by hash, against brute force over all
    vectors. The queries are the only thing that is shipped to every task."""
    queries = vectors.orderBy(F.xxhash64("vec", F.lit(5))).limit(plan.audited).select("vec", "label", "embedding").toPandas()
    if not len(queries):
        return 1.0
    asked = {key: (g["vec"].to_numpy(), matrix(g["embedding"])) for key, g in queries.groupby(
        ["label", queries["embedding"].map(len)])}

    def run(batches):
        for pdf in batches:
            for key, g in pdf.groupby(["label", pdf["embedding"].map(len)]):
                if key in asked:
                    ids, x = asked[key]
                    hit = (matrix(g["embedding"]) @ x.T >= plan.cosine) & (g["vec"].to_numpy()[:, None] != ids)
                    yield pd.DataFrame({"vec": ids, "true": g["copies"].to_numpy() @ hit})

    true = vectors.select("vec", "label", "copies", "embedding").mapInPandas(run, "vec bigint, true bigint").groupBy("vec").agg(
        F.sum("true").alias("true"))
    row = true.join(counted, "vec", "left").agg(
        F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return row.found / row.true if row.true else 1.0


def near_duplicates(embeddings: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``embeddings(vec_id, embedding, label)``.

    n_links counts the other rows linked directly (never one below the bound: every link is confirmed in double
    precision), component_id is the smallest vec_id reachable. Vectors are compared within a label and a
    dimension. Null labels, and vectors that are null, zero, or hold null or non-finite components, link
    with nothing; a null vec_id too, and has a null component_id and is kept. Equal vectors of a label are one
    point of the graph with their number as weight, so copies cost nothing. A vec_id names one vector.
    Extra columns are ignored; an empty table gives no rows.

    The result's recall is audited on a bounded sample of queries; below ``plan.recall`` all vectors of a label are
    compared in blocks instead, which is exact.
    """
    rows = embeddings.where(usable()).select("vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding"))
    points = stage(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies")), "points")
    found = search_links(points, plan)
    counted = found.groupBy("vec").agg(F.sum("links").alias("links"))
    if audit(points, counted, plan) < plan.recall:
        whole = points.select("vec", "copies", "embedding", F.concat_ws(":", "label", F.size("embedding")).alias("shard"), F.lit(True).alias("main"))
        found = stage(block_links(whole, plan), "found")
        counted = found.groupBy("vec").agg(F.sum("links").alias("links"))
    classes = components(found.where("low <> vec").select(F.col("vec").alias("u"), F.col("low").alias("v")))
    judged = points.join(counted, "vec", "left").join(classes.select(F.col("node").alias("vec"), "component"), "vec", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec").alias("component_id"))
    linked = rows.join(judged, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~usable()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
