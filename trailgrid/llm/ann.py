"""Approximate nearest neighbours by balanced posting lists, for the largest inner product.

Centroids of a bounded sample are balanced by splitting large clusters; lists that grow beyond four
times LIST are split again by centroids of their own, level by level, so lists stay short however many
vectors there are. A vector goes to the list of its nearest centroid and, near a boundary, to all within
a distance ratio. A query finds first-level centroids through a neighbour graph held in memory and
searches all lists within a distance ratio of the nearest: nothing else ends the search. That ratio is
fitted for each level to RECALL by exact answers of PROBES queries against all vectors; where vectors
have no structure (uniform directions in many dimensions) it grows until most lists are searched.
Inner products become distances by one more component (the missing norm), so norms may differ.
Lists that lie near one another stand on one shelf, which a task reads at once, so that a query passes
on its best of a shelf and not of every list; what a query reads is always at least what it selected,
and what stands on several lists of a shelf is there once.
Equal vectors are indexed once with their k + 1 smallest ids, which is all that a result can hold;
shelves and their queries are cut into blocks, so that no task holds a whole large one. A query that
finds fewer than k is compared with all vectors, in blocks.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; a vector
shorter than the longest has zeros there; components are compared as they are given, in double precision;
rows with a null id take no part; repeated ids with equal vectors count once; no query gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy, unit

#: Vectors that first centroids are fitted on (at most, a bounded sample by a hash of the id), vectors of a list, centroids that a list is split by, levels of splits.
SAMPLE, LIST, FANOUT, LEVELS = 32_768, 500, 64, 3
#: Distance ratio within which a vector is replicated; recall that search ratios are fitted to, and queries that they are fitted by.
REPLICA_RATIO, RECALL, PROBES = 1.02, 0.98, 128
#: Links of a centroid in the graph; candidates that a search holds at first (doubled where all of them are within the ratio).
LINKS, BEAM = 24, 32
#: Lists of a shelf; bytes of vectors and number of queries that one task compares, and queries at a time.
SHELF, BLOCK_BYTES, QUERY_BLOCK, AT_ONCE = 16, 1 << 24, 4096, 128
_STEP = 8192


class Centroids:
    """Centroids with a neighbour graph for batches of searches."""

    def __init__(self, points: np.ndarray):
        self.points, k = points.astype(np.float64), len(points)
        self.square = (self.points**2).sum(1)
        links = []
        for a in range(0, k, 512):
            d = self.square - 2 * self.points[a : a + 512] @ self.points.T
            links.append(np.argsort(d, axis=1)[:, : LINKS + 1])
        ring = (np.arange(k)[:, None] + [1, k // 2 or 1]) % k  # keeps the graph connected
        links = np.sort(np.concatenate([np.concatenate(links), ring], axis=1), axis=1)
        own = np.arange(k)[:, None]
        self.links = np.where(np.concatenate([np.zeros((k, 1), bool), links[:, 1:] == links[:, :-1]], axis=1), own, links)
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))

    def _beam(self, x: np.ndarray, ratio: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of at most `width` centroids for each row, by best-first search: the next to open must be within the ratio or among the BEAM / 4 nearest."""
        n, width = len(x), min(width, len(self.points))
        square, limit = (x**2).sum(1), max(1, BEAM // 4)
        away = lambda r, c: np.sqrt(np.maximum(square[r, None] + self.square[c] - 2 * np.einsum("nd,nmd->nm", x[r], self.points[c]), 0))
        seen = np.zeros((n, len(self.points)), bool)
        start = np.tile(self.entries, (n, 1))
        seen[:, self.entries] = True
        ids, d, opened = start, away(np.arange(n), start), np.zeros(start.shape, bool)
        pad = max(0, width - ids.shape[1])
        ids, d, opened = np.pad(ids, ((0, 0), (0, pad))), np.pad(d, ((0, 0), (0, pad)), constant_values=np.inf), np.pad(opened, ((0, 0), (0, pad)), constant_values=True)
        rows = np.arange(n)
        while len(rows):
            waiting = np.where(opened[rows], np.inf, d[rows])
            at = waiting.argmin(1)
            nearest, held = waiting[np.arange(len(rows)), at], d[rows]
            edge = np.partition(held, min(limit, held.shape[1]) - 1, axis=1)[:, min(limit, held.shape[1]) - 1]
            goes = np.isfinite(nearest) & (nearest <= np.maximum(held.min(1) * ratio + 1e-9, edge))
            rows, at = rows[goes], at[goes]
            if not len(rows):
                break
            opened[rows, at] = True
            near = self.links[ids[rows, at]]
            new = np.where(seen[rows[:, None], near], np.inf, away(rows, near))
            seen[rows[:, None], near] = True
            all_ids, all_d = np.concatenate([ids[rows], near], axis=1), np.concatenate([d[rows], new], axis=1)
            all_open = np.concatenate([opened[rows], np.isinf(new)], axis=1)
            keep = np.argpartition(all_d, width - 1, axis=1)[:, : ids.shape[1]]
            ids[rows], d[rows], opened[rows] = (np.take_along_axis(z, keep, 1) for z in (all_ids, all_d, all_open))
        return ids, d

    def search(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, distance) of all centroids within ratio times the distance of the nearest, as the graph finds them."""
        x, out, width, rows = x.astype(np.float64), [], BEAM, np.arange(len(x))
        while len(rows):
            ids, d = self._beam(x[rows], ratio, width)
            fits = d <= d.min(1, keepdims=True) * ratio + 1e-9
            done = ~fits.all(1) if width < len(self.points) else np.ones(len(rows), bool)
            r, c = np.nonzero(fits & done[:, None])
            out.append((rows[r], ids[r, c], d[r, c]))
            rows, width = rows[~done], width * 2
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, int) for i in range(3))


def balanced_centroids(x: np.ndarray, k: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """k means whose large clusters are split into the places of the smallest."""
    rng = np.random.default_rng(seed)
    centre = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].astype(np.float64)
    for r in range(rounds):
        near = np.concatenate([((centre**2).sum(1) - 2 * x[a : a + 4096] @ centre.T).argmin(1) for a in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
        if r + 2 < rounds:
            order, limit = np.argsort(size, kind="stable"), 2 * len(x) / len(centre)
            for small, large in zip(order, order[::-1]):
                if size[large] <= limit or size[small] * 2 >= size[large]:
                    break
                centre[small] = x[rng.choice(np.flatnonzero(near == large))] * 0.5 + centre[large] * 0.5
    return centre


def shelves_of(points: np.ndarray, size: int) -> np.ndarray:
    """A number for each centroid: halves across the widest axis until no more than `size` are together."""
    out, todo, n = np.zeros(len(points), int), [np.arange(len(points))], 0
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out[at], n = n, n + 1
            continue
        centred = points[at] - points[at].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = at[np.argsort(centred @ axis, kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centre**2).sum(1) - 2 * x @ centre.T, 0))


class Space:
    """How vectors are read: padded to `dim`, scaled so that the longest has norm 1, and lifted by the missing norm."""

    def __init__(self, dim: int, scale: float, longest: float):
        self.dim, self.scale, self.longest = dim, scale, longest

    def rows(self, vectors) -> np.ndarray:
        given = list(vectors)
        if all(len(v) == self.dim for v in given):
            return np.asarray(np.stack(given), np.float64) if given else np.zeros((0, self.dim))
        out = np.zeros((len(given), self.dim))
        for i, v in enumerate(given):
            out[i, : len(v)] = v
        return out

    def lift(self, vectors) -> np.ndarray:
        x = self.rows(vectors) / self.scale / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))[:, None]], axis=1)

    def lift_query(self, vectors) -> np.ndarray:
        x = self.rows(vectors) / self.scale
        return np.concatenate([x / np.sqrt((x**2).sum(1))[:, None], np.zeros((len(x), 1))], axis=1)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable rows once each, components of single precision as they are, others as doubles; -0 is 0."""
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = element if element == "float" else "double"
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda c: c.cast(kind) + F.lit(0.0).cast(kind)).alias("v"))
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.where(F.col("id").isNotNull() & v.isNotNull()).where(fine).distinct()


def _best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the `most` largest inner products of each row of y, of equal ones the smaller ids."""
    rough = y @ x.T
    if len(ids) > most:
        edge = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
        row, col = np.nonzero(rough >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None])
    else:
        row, col = (z.ravel() for z in np.indices(rough.shape))
    exact = (x[col] * y[row]).sum(1)  # the same sum for equal vectors wherever they stand
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    first = np.searchsorted(row, np.arange(len(y)))
    keep = np.arange(len(row)) - first[row] < most
    return row[keep], ids[col[keep]], exact[keep]


def _compare(space: Space, most: int):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Vectors and queries of one pair of blocks: the best of each query."""
        if not len(a) or not len(b):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "vid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, ids, asked, out = space.rows(a["v"]), a["vid"].to_numpy(), b["vid"].to_numpy(), []
        for at in range(0, len(b), AT_ONCE):
            row, near, score = _best(x, ids, space.rows(b["v"].iloc[at : at + AT_ONCE]), most)
            out.append(pd.DataFrame({"query": asked[at + row], "vid": near, "score": score}))
        return pd.concat(out)

    return run


def _blocks(space: Space) -> int:
    return max(1024, BLOCK_BYTES // (8 * space.dim))


def _paired(left: DataFrame, right: DataFrame, space: Space, most: int) -> DataFrame:
    """Best (query, vid, score) of every block of vectors (shelf, vid, v) and block of queries of the same shelf."""
    sizes = left.groupBy("shelf").agg(F.ceil(F.count("*") / _blocks(space)).alias("pn")).join(right.groupBy("shelf").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("qn")), "shelf")
    deal = lambda df, own, other, a, b: df.join(sizes, "shelf").withColumn(a, F.pmod(F.xxhash64("vid"), F.col(own))).withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).select("shelf", "pb", "qb", "vid", "v")
    a, b = deal(left, "pn", "qn", "pb", "qb"), deal(right, "qn", "pn", "qb", "pb")
    return a.groupBy("shelf", "pb", "qb").cogroup(b.groupBy("shelf", "pb", "qb")).applyInPandas(_compare(space, most), "query long, vid long, score double")


def _split(post: DataFrame, space: Space) -> tuple[DataFrame, DataFrame] | None:
    """Lists of more than 4 LIST vectors by centroids of their own: (children (list, child, centre), posts of the children); None if there is none."""
    sizes = post.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > 4 * LIST)
    if sizes.isEmpty():
        return None

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        centre = balanced_centroids(space.lift(group["v"]), int(np.clip(group["n"].iloc[0] // LIST, 2, FANOUT)))
        one = int(group["list"].iloc[0])
        return pd.DataFrame({"list": one, "child": (one + 1) * _STEP + np.arange(len(centre)), "centre": list(centre)})

    first = F.row_number().over(Window.partitionBy("list").orderBy(F.xxhash64("vid", F.lit("split"))))
    drawn = post.join(sizes, "list").withColumn("o", first).where(F.col("o") <= 16 * FANOUT).select("list", "n", "v")
    return drawn.groupBy("list").applyInPandas(fit, "list long, child long, centre array<double>"), sizes


def _to_children(rows: DataFrame, children: DataFrame, sizes: DataFrame, space: Space, lifted, ratio: float, element: str) -> DataFrame:
    """rows (list, vid, v) of split lists to their children within the ratio: list, vid, v, d; rows of a list in blocks."""
    parts = F.ceil(F.col("n") / _blocks(space))
    dealt = rows.join(sizes, "list").withColumn("pb", F.pmod(F.xxhash64("vid"), parts)).drop("n")
    kids = children.join(sizes, "list").withColumn("pb", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"list": pd.Series(dtype="int64"), "vid": pd.Series(dtype="int64"), "v": pd.Series(dtype="object"), "d": pd.Series(dtype="float64")})
        d = distances(lifted(a["v"]), np.stack(b["centre"].to_numpy()))
        row, col = np.nonzero(d <= d.min(1, keepdims=True) * ratio + 1e-9)
        return pd.DataFrame({"list": b["child"].to_numpy()[col], "vid": a["vid"].to_numpy()[row], "v": a["v"].to_numpy()[row], "d": d[row, col]})

    return dealt.groupBy("list", "pb").cogroup(kids.groupBy("list", "pb")).applyInPandas(run, f"list long, vid long, v array<{element}>, d double")


def _fitted(truth: pd.DataFrame, y: np.ndarray, held: DataFrame, centres: DataFrame | np.ndarray, recall: float) -> float:
    """The ratio within which lists hold `recall` of the true neighbours (probe, vid), given posts (list, vid) and centres (list, centre)."""
    spark = held.sparkSession
    if not len(truth):
        return math.inf
    wanted = held.join(F.broadcast(spark.createDataFrame(truth[["probe", "vid"]])), "vid").select("probe", "vid", "list").toPandas()  # at most PROBES x k x replicas
    if isinstance(centres, np.ndarray):
        d = distances(y, centres)
        nearest, wanted["d"] = d.min(1), d[wanted["probe"], wanted["list"]]
    else:
        needed = set(wanted["list"].tolist())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                d, ids = distances(y, np.stack(batch["centre"].to_numpy())), batch["list"].to_numpy()
                at = np.flatnonzero([i in needed for i in ids.tolist()])
                yield pd.DataFrame({"probe": np.repeat(np.arange(len(y)), len(at) + 1), "list": np.tile(np.append(ids[at], -1), len(y)), "d": np.concatenate([d[:, at], d.min(1)[:, None]], axis=1).ravel()})

        told = centres.mapInPandas(tidy(run), "probe long, list long, d double").groupBy("probe", "list").agg(F.min("d").alias("d")).toPandas()
        nearest = told[told["list"] == -1].sort_values("probe")["d"].to_numpy()
        wanted = wanted.merge(told, on=["probe", "list"])
    need = (wanted["d"] / np.maximum(nearest[wanted["probe"]], 1e-12)).groupby([wanted["probe"], wanted["vid"]]).min()
    return float(np.quantile(need, recall)) if len(need) else math.inf


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by `every`."""
    spark, scratch, most = vectors.sparkSession, Scratch(vectors.sparkSession, "ann"), k + 1
    kept = _usable(vectors, id_col, vector_col)
    element = kept.schema["v"].dataType.elementType.simpleString()
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = kept.withColumn("o", first).where(F.col("o") <= most)
    known = scratch.keep(least.groupBy("v").agg(F.min("id").alias("vid"), F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asking = scratch.keep(kept.where(F.col("id") % every == 0).select("id", "v").join(known.select("v", "vid"), "v").select("id", "vid"), "asking")
    absolute = lambda c: F.abs(c.cast("double"))
    stats = known.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", absolute))).alias("scale")).first()
    count, dim, scale = stats["n"], stats["dim"], stats["scale"]
    queries = scratch.keep(known.join(asking.select("vid").distinct(), "vid").select("vid", "v"), "queries")
    if not count or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c.cast("double") / scale) * (c.cast("double") / scale)))
    space = Space(dim, scale, known.agg(F.max(norm)).first()[0])
    draw = lambda df, n, most_, what: [*df.where(unit("vid", F.lit(what)) < min(1.0, 0.95 * most_ / n)).select("vid", "v").limit(most_).toLocalIterator()] or [df.select("vid", "v").first()]
    sample = space.lift(r["v"] for r in draw(known, count, SAMPLE, "ann sample"))
    top = balanced_centroids(sample, int(np.clip(count // LIST, 1, max(1, min(len(sample), SAMPLE) // 8))))
    index = spark.sparkContext.broadcast(top)  # at most SAMPLE / 8 rows

    def to_lists(ratio: float, lifted):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph = Centroids(index.value)
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.iloc[at : at + 512]
                    row, ids, d = graph.search(lifted(part["v"]), ratio)
                    yield pd.DataFrame({"list": ids, "vid": part["vid"].to_numpy()[row], "v": part["v"].to_numpy()[row], "d": d})

        return run

    schema = f"list long, vid long, v array<{element}>, d double"
    post = scratch.keep(known.select("vid", "v").mapInPandas(tidy(to_lists(REPLICA_RATIO, space.lift)), schema).drop("d"), "lists0")
    levels, tiers = [(post, top, None)], post
    for level in range(1, LEVELS + 1):
        made = _split(tiers, space)
        if made is None:
            break
        children, sizes = scratch.keep(made[0], f"children{level}"), scratch.keep(made[1], f"sizes{level}")
        below = _to_children(tiers.join(sizes.select("list"), "list", "left_semi"), children, sizes, space, space.lift, REPLICA_RATIO, element).drop("d")
        tiers = scratch.keep(tiers.join(sizes.select("list"), "list", "left_anti").unionByName(below), f"lists{level}")
        levels.append((tiers, None, (children, sizes)))

    # Exact answers of some queries against all vectors tell how far to search.
    drawn = draw(queries, queries.count(), PROBES, "ann probes")
    probes, own = space.rows(r["v"] for r in drawn), np.array([r["vid"] for r in drawn])
    tell = spark.sparkContext.broadcast(probes)  # at most PROBES rows

    def exactly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, ids, score = _best(space.rows(batch["v"]), batch["vid"].to_numpy(), tell.value, most)
            yield pd.DataFrame({"probe": row, "vid": ids, "score": score})

    nth = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vid"))
    truth = known.select("vid", "v").mapInPandas(tidy(exactly), "probe long, vid long, score double").withColumn("o", nth).where(F.col("o") <= most).toPandas()  # PROBES x (k + 1)
    truth = truth[truth["vid"].to_numpy() != own[truth["probe"].to_numpy()]]
    lifted = space.lift_query(probes)
    each, centres = recall ** (1 / len(levels)), spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(top)], "list long, centre array<double>")
    ratios = [_fitted(truth, lifted, post, top, each)]
    for held, _, (children, sizes) in levels[1:]:
        centres = centres.join(sizes.select("list"), "list", "left_anti").unionByName(children.select(F.col("child").alias("list"), "centre"))
        centres = scratch.keep(centres, f"centres{len(ratios)}")
        ratios.append(_fitted(truth, lifted, held, centres, each))

    wanted = queries.mapInPandas(tidy(to_lists(ratios[0], space.lift_query)), schema)
    for level, (_, _, (children, sizes)) in enumerate(levels[1:], 1):
        wanted = scratch.keep(wanted, f"wanted{level}")
        below = _to_children(wanted.join(sizes.select("list"), "list", "left_semi").drop("d"), children, sizes, space, space.lift_query, math.inf, element)
        both = wanted.join(sizes.select("list"), "list", "left_anti").unionByName(below)
        wanted = both.withColumn("least", F.min("d").over(Window.partitionBy("vid"))).where(F.col("d") <= F.col("least") * ratios[level] + 1e-9).drop("least")
    places = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(shelves_of(top, SHELF))], "list long, place long"))  # at most SAMPLE / 8 rows
    # Children of one list have numbers in a row: SHELF of them share a shelf.
    shelved = lambda df: df.join(places, "list", "left").select(F.coalesce("place", F.floor(F.col("list") / SHELF) + (1 << 20)).alias("shelf"), "vid", "v").dropDuplicates(["shelf", "vid"])
    wanted = scratch.keep(shelved(wanted), "wanted")
    found = scratch.keep(_paired(scratch.keep(shelved(tiers), "shelves"), wanted, space, most).groupBy("query", "vid").agg(F.max("score").alias("score")), "found")
    # Queries that met fewer vectors than a result holds are compared with all of them.
    enough = min(most, count)
    full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    short = queries.join(full.select(F.col("query").alias("vid")), "vid", "left_anti").withColumn("shelf", F.lit(-1).cast("long"))
    if not short.isEmpty():
        again = _paired(known.select(F.lit(-1).cast("long").alias("shelf"), "vid", "v"), scratch.keep(short, "short"), space, most)
        found = found.unionByName(again).groupBy("query", "vid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    found = found.withColumn("o", F.row_number().over(best)).where(F.col("o") <= most).join(known.select("vid", "ids"), "vid").select("query", "score", F.explode("ids").alias("cand"))
    rows_of = found.withColumn("o", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cand"))).where(F.col("o") <= most)
    mine = asking.join(rows_of, asking["vid"] == rows_of["query"]).where("cand != id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "cand"))
    return mine.select(F.col("id").alias("query_id"), rank.alias("rank"), F.col("cand").alias("vec_id"), "score").where(F.col("rank") <= k)
