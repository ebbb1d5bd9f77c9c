"""An index of vectors: inverted lists around centres, searched exactly.

Each vector stands in the list (``cell``) of its nearest centre, with its distance to that centre (``away``). By the triangle inequality a vector
is no nearer to a target than the target's distance to the centre and ``away`` differ. So some lists near the target give
an upper bound of the k-th distance, and then only the parts of lists are read that may hold something nearer: ranges of ``away`` in some
cells, which reach the scan of an index that is stored in that order. What is left out can't be among the answers, so they are those of a
scan, ties (by the key) included.

The centres are fitted in one task on a bounded sample (SAMPLE vectors of the lowest hashes of their keys); they only decide how much is read, not
what is found. Vectors that are null, hold nulls or no numbers, or have another dimension than the centres' are in no list."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T

#: Vectors that centres are fitted on, centres, and rounds of fitting, at most. Centres and their radii are broadcast: 2048 x dimension numbers.
SAMPLE, CENTRES, ROUNDS = 20_000, 2048, 12
#: Slack of the bounds, as a share of the distances: sums of floating point numbers in another order differ less.
SLACK = 1e-6
INDEXED = "cell int, away double"
#: Vectors, and queries, that meet in one group, about; products of them that are held at once.
BLOCK, PRODUCTS = 8192, 1 << 22


def fit(vectors: DataFrame, key: str = "chunk_id", count: int | None = None, sample: int = SAMPLE, seed: int = 3) -> np.ndarray:
    """Centres (rows) of the vectors of the commonest dimension: by k-means on a sample; as many as the root of the number of vectors."""
    whole = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    sizes = whole.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes.dim:
        return np.zeros((0, 0))
    k = count or max(1, min(CENTRES, round(sizes.n**0.5)))
    some = whole.filter(F.size("embedding") == sizes.dim).orderBy(F.xxhash64(key), key).limit(sample).select("embedding")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.stack(f["embedding"].to_numpy()) for f in frames if len(f)]
        if held:
            yield pd.DataFrame({"centre": list(kmeans(np.concatenate(held).astype(np.float64), k, seed))})

    rows = some.repartition(1).mapInPandas(run, "centre array<double>").collect()  # k centres
    return np.array([r.centre for r in rows])


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T)]  # the same centres whatever order the rows came in
    centres = np.unique(points[rng.choice(len(points), min(k, len(points)), replace=False)], axis=0)
    for _ in range(rounds):
        of, _ = assigned(points, centres)
        size = np.bincount(of, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, of, points)
        new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def assigned(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, and the distance."""
    of, away = np.empty(len(points), np.int64), np.empty(len(points))
    for k in range(0, len(points), 1024):
        part = points[k : k + 1024]
        square = (part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1)
        of[k : k + 1024] = square.argmin(1)
        away[k : k + 1024] = np.sqrt(((part - centres[of[k : k + 1024]]) ** 2).sum(1))
    return of, away


def _matrix(values: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which values are vectors of the dimension without nulls, and these."""
    arrays = [None if v is None else np.asarray(v, np.float64) for v in values]  # a null in a vector is a NaN here
    good = np.array([v is not None and len(v) == dim and bool(np.isfinite(v).all()) for v in arrays], bool)
    return good, np.stack([v for v, g in zip(arrays, good) if g]) if good.any() else np.zeros((0, dim))


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The vectors with cell and away (null in no list)."""
    shared, dim = vectors.sparkSession.sparkContext.broadcast(centres), centres.shape[1]

    @F.pandas_udf(INDEXED)
    def place(embedding: pd.Series) -> pd.DataFrame:
        good, points = _matrix(embedding, dim)
        cell, away = pd.array([None] * len(embedding), "Int32"), np.full(len(embedding), np.nan)
        if len(points) and len(shared.value):
            found = assigned(points, shared.value)
            cell[good], away[good] = found[0].astype(np.int32), found[1]
        return pd.DataFrame({"cell": cell, "away": pd.array(np.where(np.isnan(away), None, away), "Float64")})

    rows = vectors.drop("cell", "away").withColumn("_place", place("embedding"))
    return rows.select(*(c for c in rows.columns if c != "_place"), "_place.cell", "_place.away")


def lists(index: DataFrame) -> dict[int, tuple[int, float, float]]:
    """Of each list: how many vectors, the least and the greatest distance to the centre. As many rows as there are centres."""
    rows = index.filter(F.col("cell").isNotNull()).groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most")).collect()
    return {r.cell: (r.n, r.least, r.most) for r in rows}


def _ranges(to_centre: np.ndarray, known: dict[int, tuple[int, float, float]], bound: float) -> list[tuple[int, float, float]]:
    """The lists that may hold something within the bound, and the ranges of away there."""
    out = []
    for cell, (_, least, most) in known.items():
        d = float(to_centre[cell])
        slack = SLACK * (1 + d + bound) if np.isfinite(bound) else 0.0
        low, high = d - bound - slack, d + bound + slack
        if low <= most and high >= least:
            out.append((cell, low, high))
    return out


def _within(ranges: list[tuple[int, float, float]]) -> Column:
    """A test of cell and away that the scan of a stored index can prune by."""
    whole = [c for c, low, high in ranges if not np.isfinite(high)]
    tests = [(F.col("cell") == c) & F.col("away").between(low, high) for c, low, high in ranges if np.isfinite(high)]
    return reduce(lambda a, b: a | b, tests + ([F.col("cell").isin(*whole)] if whole else []), F.lit(False)) & F.col("cell").isin(*(c for c, _, _ in ranges))


def nearest(index: DataFrame, centres: np.ndarray, known: dict[int, tuple[int, float, float]], target: list[float], limit: int, key: str = "chunk_id", where: Column | None = None) -> DataFrame:
    """As ``search.nearest``, from the index: one look at the lists nearest to the target for a bound, and one at what the bound leaves."""
    limit, columns = max(1, limit), [c for c in index.columns if c not in ("embedding", "cell", "away")]
    goal = F.array(*(F.lit(float(x)) for x in target))
    far = lambda rows: rows.withColumn("distance", T.distance(F.col("embedding"), goal)).select(*columns, "distance")
    if not len(centres) or centres.shape[1] != len(target):
        return far(index.filter("false"))
    rows = index.filter(F.size("embedding") == len(target))  # of another dimension than the centres' since the index was begun anew
    rows = rows if where is None else rows.filter(where)
    to_centre = np.sqrt(((centres - np.asarray(target, np.float64)) ** 2).sum(1))
    order, bound, take = sorted(known, key=lambda c: (to_centre[c], c)), np.inf, 0
    while not np.isfinite(bound) and take < len(order):  # lists that a filter empties are made up for by more of them
        held = 0
        take = max(take * 4, 1)
        while take < len(order) and (held := sum(known[c][0] for c in order[:take])) < limit:
            take += 1
        near = far(rows.filter(F.col("cell").isin(*order[:take]))).orderBy("distance").limit(limit)
        first = near.agg(F.count("*").alias("n"), F.max("distance").alias("bound")).first()
        bound = first.bound if first.n == limit else np.inf
    left = _ranges(to_centre, known, bound)
    return far(rows.filter(_within(left)) if left else rows.filter("false")).orderBy("distance", key).limit(limit)


def blocks(known: dict[int, tuple[int, float, float]], centres: np.ndarray, most: int = BLOCK) -> list[tuple[list[int], int]]:
    """Lists dealt to blocks of about ``most`` vectors, neighbours together: (cells, parts); a list that is longer is a block by itself, in parts.
    As many entries as there are lists, at most."""
    if not known:
        return []
    out: list[tuple[list[int], int]] = []
    order = sorted(known, key=lambda c: (float(centres[c] @ _axis(centres)), c))
    here, held = [], 0
    for c in order:
        n = known[c][0]
        if n > most:
            out.append(([c], -(-n // most)))
            continue
        if here and held + n > most:
            out.append((here, 1))
            here, held = [], 0
        here.append(c)
        held += n
    return out + ([(here, 1)] if here else [])


def _axis(centres: np.ndarray) -> np.ndarray:
    """The direction in which the centres differ most."""
    return np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]


def _exact(points: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, summed in the order of ``text.distance``, so that ties are the same."""
    out = np.zeros(len(points))
    for k in range(points.shape[1]):
        out += (points[:, k] - targets[:, k]) ** 2
    return np.sqrt(out)


def _first_of(points: np.ndarray, keys: np.ndarray, targets: np.ndarray, bounds: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each target (places, keys, distances) the first ``limit`` points within its bound, by distance and key. Products of matrices tell
    what may be among them; these alone are measured exactly."""
    square, step = (points**2).sum(1), max(1, PRODUCTS // max(1, len(points)))
    for k in range(0, len(targets), step):
        part = targets[k : k + step]
        own = (part**2).sum(1)
        near = square[None, :] - 2 * part @ points.T + own[:, None]
        limits = bounds[k : k + step] ** 2
        if len(points) > limit and np.isinf(limits).any():
            limits = np.minimum(limits, np.partition(near, limit - 1, axis=1)[:, limit - 1])
        slack = SLACK * (1 + own + square.max())
        who, which = np.nonzero(near <= (limits + slack)[:, None])
        far = np.empty(len(who))
        for j in range(0, len(who), 1 << 16):
            far[j : j + (1 << 16)] = _exact(points[which[j : j + (1 << 16)]], part[who[j : j + (1 << 16)]])
        order = np.lexsort((keys[which], far, who))
        who, which, far = who[order], which[order], far[order]
        kept = np.arange(len(who)) - np.searchsorted(who, who) < limit
        yield k + who[kept], keys[which[kept]], far[kept]


def nearest_all(index: DataFrame, centres: np.ndarray, known: dict[int, tuple[int, float, float]], queries: DataFrame, limit: int, key: str = "chunk_id") -> DataFrame:
    """query, key, distance and rank: the ``limit`` nearest of each of a set of queries (query, target). The lists are dealt to blocks of at most about
    BLOCK vectors. Queries go to the blocks that they must read, first for a bound, then for the answers; a block meets at most about BLOCK of them
    at once, as matrices. Neither vectors nor queries need to fit anywhere, and hot lists are blocks by themselves, in parts."""
    from pyspark.sql import Window

    dealt = blocks(known, centres)
    place = {c: b for b, (cells, _) in enumerate(dealt) for c in cells}
    held = [sum(known[c][0] for c in cells) for cells, _ in dealt]
    shared = queries.sparkSession.sparkContext.broadcast((centres, known, dealt, place, held))
    dim = centres.shape[1] if len(centres) else 0
    kind, key_kind = queries.schema["query"].dataType.simpleString(), index.schema[key].dataType.simpleString()
    asked = queries.select("query", F.col("target").cast("array<double>").alias("target"))
    groups = max(1, -(-asked.count() // BLOCK))

    def looks(bounded: bool):  # noqa: ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, lists_, dealt_, place_, held_ = shared.value
            cells = np.array(sorted(lists_), np.int64)
            of = np.array([place_[c] for c in cells], np.int64)
            least, most = (np.array([lists_[c][k] for c in cells], float) for k in (1, 2))
            for frame in frames:
                good, points = _matrix(frame["target"], dim)
                part, out = frame[good], []
                for query, target, bound, point in zip(part["query"], part["target"], part["bound"] if bounded else [np.inf] * len(part), points):
                    d = np.sqrt(((own[cells] - point) ** 2).sum(1))
                    if bounded and np.isfinite(bound):
                        slack = SLACK * (1 + d + bound)
                        wanted = np.unique(of[(d - bound - slack <= most) & (d + bound + slack >= least)])
                    elif bounded:
                        wanted = np.arange(len(dealt_))
                    else:
                        wanted, n = [], 0
                        for b in dict.fromkeys(of[np.argsort(d, kind="stable")]):
                            wanted.append(b)
                            n += held_[b]
                            if n >= limit:
                                break
                    out += [(query, target, bound, int(b), p) for b in wanted for p in range(dealt_[b][1])]
                yield pd.DataFrame(out, columns=["query", "target", "bound", "block", "part"])

        return run

    shape = f"query {kind}, target array<double>, bound double, block int, part int"
    rows = index.filter(F.col("cell").isNotNull() & (F.size("embedding") == dim)).select(key, "embedding", "cell")

    @F.pandas_udf("block int, parts int")
    def lies(cell: pd.Series) -> pd.DataFrame:
        at = cell.map(shared.value[3])
        return pd.DataFrame({"block": at.astype("int32"), "parts": at.map(lambda b: shared.value[2][b][1]).astype("int32")})

    rows = rows.withColumn("_lies", lies("cell")).select(key, "embedding", F.col("_lies.block").alias("block"), F.pmod(F.xxhash64(key), F.col("_lies.parts")).cast("int").alias("part"))
    rows = rows.withColumn("several", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": left["query"][:0], key: right[key][:0], "distance": np.zeros(0)})
        points, targets = (np.stack(f.to_numpy()).astype(np.float64) for f in (right["embedding"], left["target"]))
        names, found = left["query"].to_numpy(), _first_of(points, right[key].to_numpy(), targets, left["bound"].to_numpy(np.float64), limit)
        return pd.concat([pd.DataFrame({"query": names[who], key: keys, "distance": far}) for who, keys, far in found])

    def first(looked: DataFrame) -> DataFrame:
        by = ("block", "part", "several")
        looked = looked.withColumn("several", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
        met = looked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(meet, f"query {kind}, {key} {key_kind}, distance double")
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", key))).filter(F.col("rank") <= limit)

    bound = first(asked.mapInPandas(looks(False), shape)).groupBy("query").agg(F.when(F.count("*") >= limit, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
    return first(asked.join(bound, "query").mapInPandas(looks(True), shape))


def share_read(index: DataFrame, centres: np.ndarray, known: dict[int, tuple[int, float, float]], queries: DataFrame, answers: DataFrame) -> float:
    """Which share of all vectors the second look of ``nearest_all`` reads, over all queries."""
    bound = answers.groupBy("query").agg(F.max("distance").alias("bound"))
    total = sum(n for n, _, _ in known.values())
    read, asked = 0, 0
    for r in queries.join(bound, "query").select("target", "bound").toLocalIterator():
        d = np.sqrt(((centres - np.asarray(r.target, np.float64)) ** 2).sum(1))
        left = _ranges(d, known, r.bound)
        read += index.filter(_within(left)).count() if left else 0
        asked += 1
    return read / max(1, asked * total)
