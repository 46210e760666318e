"""Exploratory spatial statistics: kernel density, Moran's I, LISA, Ripley's K and L, stationarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.functions import numerics
from cellwise.functions.grid import GridSpec
from cellwise.functions.stats import two_sided_p, z_threshold
from cellwise.operators.forecast import by_length, series_of
from cellwise.operators.neighbors import neighbour_sums
from cellwise.operators.spatial_join import STRIP, block_pairs, pairs_around, pairs_upto, squared

#: Points of a tile of a random pattern, about.
TILE = 65536


def kde_bandwidth(points: DataFrame) -> float:
    """Deviation of all coordinates, x and y pooled, times n to the power -1/6."""
    r = points.agg(F.count("x"), F.avg("x"), F.avg("y"), F.var_pop("x"), F.var_pop("y")).first()
    if not r[0]:
        return 1.0
    return math.sqrt((r[3] + r[4]) / 2 + ((r[1] - r[2]) / 2) ** 2) * r[0] ** (-1 / 6)


def kde(points: DataFrame, spec: GridSpec, bandwidth: float | None = None) -> DataFrame:
    """flat_idx, row, col, density: the mean over the events of a Gaussian around them, at each cell's centre.

    The kernel is a product of one in x and one in y, so a block of events takes a matrix product and sends one row
    per cell; no event is joined with a cell.
    """
    h = bandwidth or kde_bandwidth(points)
    cx = spec.minx + (np.arange(spec.ncols) + 0.5) * spec.cell_size
    cy = spec.miny + (np.arange(spec.nrows) + 0.5) * spec.cell_size
    index = np.arange(spec.n_cells)

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((spec.nrows, spec.ncols)), 0
        for b in batches:
            ex = np.exp(-0.5 * ((b["x"].to_numpy()[:, None] - cx) / h) ** 2)
            ey = np.exp(-0.5 * ((b["y"].to_numpy()[:, None] - cy) / h) ** 2)
            total += ey.T @ ex
            n += len(b)
        if n:
            yield pd.DataFrame({"flat_idx": index.astype("int32"), "s": total.reshape(-1), "n": n})

    parts = points.select("x", "y").dropna().mapInPandas(block, "flat_idx int, s double, n long")
    sums = parts.groupBy("flat_idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    density = F.col("s") / (2 * math.pi * h * h * F.col("n"))
    return spec.cells(points.sparkSession).select("flat_idx", "row", "col").join(sums, "flat_idx", "left").select("flat_idx", "row", "col", F.coalesce(density, F.lit(0.0)).alias("density"))


def moran_global(grid: DataFrame, spec: GridSpec, value: str = "count", reference_variance: bool = False) -> DataFrame:
    """I, E_I, z, p_value of one grid under binary queen weights, with the variance under randomisation.

    reference_variance: with the kurtosis term left undivided by the mean square, as the analysed library has it.
    """
    n = float(spec.n_cells)
    one = grid.withColumn("t", F.lit(0))
    mean = one.agg(F.avg(value).alias("mean"))
    centred = one.join(F.broadcast(mean)).select("t", "row", "col", (F.col(value) - F.col("mean")).alias("z"))
    sums = neighbour_sums(centred, spec, "z", with_self=False)
    joined = centred.join(sums, ["t", "row", "col"], "left")
    deg = F.coalesce("deg", F.lit(0)).cast("double")
    s = joined.agg(
        F.sum(F.col("z") * F.coalesce("n_sum", F.lit(0.0))).alias("zwz"),
        F.sum(F.pow("z", 2)).alias("zz"),
        F.sum(F.pow("z", 4)).alias("z4"),
        F.sum(deg).alias("s0"),
        F.sum(4 * deg * deg).alias("s2"),
    ).withColumn("s1", 2 * F.col("s0"))
    k = F.col("z4") / F.pow("zz", 2) * (1.0 if reference_variance else n)
    s0, s1, s2 = F.col("s0"), F.col("s1"), F.col("s2")
    e = -1.0 / (n - 1)
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - e * e
    i = F.when(F.col("zz") < 1e-12, 0.0).otherwise(n / s0 * F.col("zwz") / F.col("zz"))
    out = s.select(i.alias("I"), F.lit(e).alias("E_I"), var.alias("var"))
    out = out.select("I", "E_I", ((F.col("I") - F.col("E_I")) / F.sqrt(F.greatest("var", F.lit(1e-12)))).alias("z"))
    return out.withColumn("p_value", two_sided_p(F.col("z")))


QUADRANTS = {1: "HH", 2: "LH", 3: "LL", 4: "HL", 0: "ns"}


def lisa(cube: DataFrame, spec: GridSpec, value: str = "count", alpha: float = 0.05) -> DataFrame:
    """Per period and cell: z, lag, local_i, its normal z (fixed variance 0.25), and quadrant and label, 0 where not significant.

    Row-standardised queen weights; local_i = z * lag / mean(z^2).
    """
    per_t = cube.groupBy("t").agg(F.avg(value).alias("mean"), F.var_pop(value).alias("m2"))
    centred = cube.join(per_t, "t").select("t", "row", "col", "flat_idx", "m2", (F.col(value) - F.col("mean")).alias("z"))
    sums = neighbour_sums(centred, spec, "z", with_self=False)
    joined = centred.join(sums, ["t", "row", "col"], "left").withColumn("lag", F.coalesce(F.col("n_sum") / F.col("deg"), F.lit(0.0)))
    local = F.when(F.col("m2") == 0, 0.0).otherwise(F.col("z") * F.col("lag") / F.col("m2"))
    rows = joined.withColumn("local_i", local).withColumn("i_z", (F.col("local_i") + 1.0 / (spec.n_cells - 1)) / 0.5)
    z, lag = F.round("z", 9), F.round("lag", 9)
    where = F.when((z > 0) & (lag > 0), 1).when((z < 0) & (lag > 0), 2).when((z < 0) & (lag < 0), 3).when((z > 0) & (lag < 0), 4).otherwise(0)
    significant = F.abs(F.round("i_z", 9)) > z_threshold(alpha)
    out = rows.select("t", "row", "col", "flat_idx", "z", "lag", "local_i", "i_z", where.alias("quadrant_all"), F.when(significant, where).otherwise(0).alias("quadrant"))
    names = F.create_map(*[x for k, v in QUADRANTS.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("label", names[F.col("quadrant")])


def drawn(seed: int, cells: np.ndarray, permutations: int, m: int, n: int) -> np.ndarray:
    """m different numbers below n for each cell and permutation (Floyd's way): the same wherever and in whatever company a cell is worked on."""
    start = (np.uint64(seed * 0xD1342543DE82EF95 % 2**64) + cells.astype(np.uint64)[:, None]) * np.uint64(0x9E3779B97F4A7C15) + np.arange(permutations, dtype=np.uint64)
    out = np.empty((len(cells), permutations, m), np.int64)
    for j in range(m):
        x = (start ^ np.uint64((j + 1) * 0xBF58476D1CE4E5B9 % 2**64)) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        pick = ((x ^ (x >> np.uint64(31))) % np.uint64(n - m + j + 1)).astype(np.int64)
        taken = (out[:, :, :j] == pick[:, :, None]).any(axis=2)
        out[:, :, j] = np.where(taken, n - m + j, pick)
    return out


def lisa_p_values(cube: DataFrame, spec: GridSpec, value: str = "count", permutations: int = 199, seed: int = 42, block: int = 1024) -> DataFrame:
    """t, flat_idx, local_i, p_sim: conditional permutations, each cell's own from its number, so that any dealing gives the same.

    A period's values are one array; blocks of its cells are dealt over all tasks, each with that array.
    """
    n, ncols, nrows = spec.n_cells, spec.ncols, spec.nrows
    shifts = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]

    def cells(z: np.ndarray, m2: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = own // ncols, own % ncols
        total, deg = np.zeros(len(own)), np.zeros(len(own), int)
        for dr, dc in shifts:
            inside = (row + dr >= 0) & (row + dr < nrows) & (col + dc >= 0) & (col + dc < ncols)
            total[inside] += z[own[inside] + dr * ncols + dc]
            deg += inside
        local = z[own] * total / np.maximum(deg, 1) / (m2 or 1) if m2 > 0 else np.zeros(len(own))
        p = np.ones(len(own))
        for d in np.unique(deg):
            at = np.flatnonzero(deg == d)
            picks = drawn(seed, own[at], permutations, int(d), n - 1)
            picks += picks >= own[at][:, None, None]  # never the cell itself
            sim = z[own[at]][:, None] * z[picks].mean(axis=2) / (m2 or 1) if d else np.zeros((len(at), permutations))
            more = (sim >= local[at][:, None]).sum(axis=1)
            p[at] = (np.minimum(more, permutations - more) + 1) / (permutations + 1)
        return local, p

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x = np.zeros(n)
                x[np.asarray(r.at)] = r.values
                z = x - x.mean()
                own = np.arange(r.first, min(r.first + block, n))
                local, p = cells(z, float((z**2).mean()), own)
                yield pd.DataFrame({"t": r.t, "flat_idx": own.astype("int32"), "local_i": local, "p_sim": p})

    whole = cube.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("flat_idx", F.col(value).cast("double").alias("v")))).alias("g"))
    dealt = whole.select("t", F.col("g.flat_idx").alias("at"), F.col("g.v").alias("values"), F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(block))).alias("first"))
    tasks = int(cube.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "t", "first").mapInPandas(run, "t int, flat_idx int, local_i double, p_sim double")


def pair_counts(points: DataFrame, distances: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of different points within each distance: (keys,) distance, pairs; also n, the number of points.

    Points at one place are one row with a weight. Pairs are counted by groups of points and never become rows.
    """
    reach = np.array(sorted(map(float, distances)))

    limits = np.array([squared(d) for d in reach])

    def count(own: tuple, a: np.ndarray, b: np.ndarray, one: bool) -> list[np.ndarray]:
        pairs = pairs_upto(a, b, limits)[:-1] * (1 if one else 2)
        return [*[np.full(len(reach), v) for v in own], np.arange(len(reach)), pairs]

    rows = points.groupBy(*keys, "x", "y").agg(F.count("*").alias("w"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    steps = F.array(*[F.lit(float(d)) for d in reach])
    found = block_pairs(rows, float(reach[-1]), keys, ("w",), count, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "k int, pairs long"]), whole=True, ahead_of=1 << 14)
    binned = found.groupBy(*keys, "k").agg(F.sum("pairs").alias("pairs"))
    n = points.groupBy(*keys).agg(F.count("*").alias("n")) if keys else points.agg(F.count("*").alias("n"))
    every = n.select(*keys, "n", F.posexplode(steps).alias("k", "distance"))
    upto = Window.partitionBy(*keys).orderBy("k")
    found = every.join(binned, [*keys, "k"], "left").withColumn("upto", F.sum(F.coalesce("pairs", F.lit(0))).over(upto))
    return found.select(*keys, "distance", "n", (F.col("upto") - F.col("n")).alias("pairs"))


def tile_sides(n: int, reach: float, width: float, height: float) -> tuple[int, int]:
    """Tiles by x and by y, of about TILE points each, and none narrower than reach if there are several."""
    side = math.sqrt(max(width * height, 1e-300) * TILE / max(n, 1))
    return tuple(max(1, int(min(length / side + 0.5, length / reach))) for length in (width, height))


def tile_points(n: int, tiles: tuple[int, int], bbox: tuple[float, float, float, float], seed: int, sim: int, wanted: list[tuple[int, int]]) -> list[np.ndarray]:
    """x, y (and a weight of one) of the wanted tiles' points of a pattern of n independent uniform points.

    How many a tile has is drawn for all tiles together, then its places from its own number, so that whoever asks for a tile gets the same points.
    """
    (left, low, right, high), (nx, ny) = bbox, tiles
    sizes = np.random.default_rng([seed, sim]).multinomial(n, np.full(nx * ny, 1 / (nx * ny)))
    made = []
    for i, j in wanted:
        x, y = np.random.default_rng([seed, sim, j * nx + i]).random((2, sizes[j * nx + i]))
        made.append(np.stack([left + (i + x) * ((right - left) / nx), low + (j + y) * ((high - low) / ny), np.ones(len(x), np.int64).view(np.float64)]))
    return made


def random_pair_counts(spark: SparkSession, n: int, distances: list[float], bbox: tuple[float, float, float, float], simulations: int, seed: int) -> DataFrame:
    """sim, distance, pairs: ordered pairs of different points within each distance, of each of as many patterns of n uniform points.

    A row is a tile of a pattern: its task draws the tile's points and its neighbours', which so need no shuffle.
    """
    reach = np.array(sorted(map(float, distances)))
    limits = np.array([squared(d) for d in reach])
    nx, ny = tile_sides(n, float(reach[-1]), bbox[2] - bbox[0], bbox[3] - bbox[1])
    tall, ideal = (bbox[3] - bbox[1]) / ny, STRIP * math.sqrt((bbox[2] - bbox[0]) * (bbox[3] - bbox[1]) / max(n, 1))
    strips = max(1, round(tall / max(ideal, reach[-1] / 4096)))

    def run(batches):
        for batch in batches:
            total: dict = {}
            for number in batch.column(0).to_pylist():
                sim, tile = divmod(number, nx * ny)
                i, j = tile % nx, tile // nx
                wanted = [(i + dx, j + dy) for dx, dy in ((0, 0), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)) if 0 <= i + dx < nx and j + dy < ny]
                own, *other = tile_points(n, (nx, ny), bbox, seed, sim, wanted)
                if not own.shape[1]:
                    continue
                far = reach[-1] + 1e-3
                near = [m[:, (m[0] >= own[0].min() - far) & (m[0] <= own[0].max() + far) & (m[1] <= own[1].max() + far)] for m in other]
                beside, above = (np.concatenate([np.zeros((3, 0)), *[m for m, (_, at) in zip(near, wanted[1:], strict=True) if at == row]], axis=1) for row in (j, j + 1))
                found = pairs_around(own, beside, above, bbox[1] + j * tall, tall / strips, strips, limits)
                found -= own.shape[1]
                total[sim] = total.get(sim, 0) + found
            sims = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(sims, np.int32), len(reach))), pa.array(np.tile(np.arange(len(reach), dtype=np.int32), len(sims))), pa.array(np.concatenate([np.zeros(0, np.int64), *[total[k] for k in sims]]))], ["sim", "k", "pairs"])

    tasks = simulations * nx * ny
    parts = max(1, min(tasks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks // 16)))
    found = spark.range(0, tasks, 1, parts).mapInArrow(run, "sim int, k int, pairs long").groupBy("sim", "k").agg(F.sum("pairs").alias("pairs"))
    steps = F.array(*[F.lit(float(d)) for d in reach])
    every = spark.range(simulations).select(F.col("id").cast("int").alias("sim"), F.posexplode(steps).alias("k", "distance"))
    return every.join(found, ["sim", "k"], "left").select("sim", "distance", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def ripley(points: DataFrame, distances: list[float], area: float) -> DataFrame:
    """distance, K, L of the points, without edge correction."""
    counts = pair_counts(points.select("x", "y").dropna(), distances)
    k = F.col("pairs") * area / (F.col("n") * (F.col("n") - 1))
    return counts.select("distance", k.alias("K")).withColumn("L", F.sqrt(F.col("K") / math.pi) - F.col("distance"))


def ripley_envelope(points: DataFrame, distances: list[float], bbox: tuple[float, float, float, float], simulations: int = 39, seed: int = 42) -> DataFrame:
    """ripley with K_lower .. L_upper of as many random patterns; nulls for none."""
    area = (bbox[2] - bbox[0]) * (bbox[3] - bbox[1])
    own = ripley(points, distances, area)
    if not simulations:
        return own.select("*", *[F.lit(None).cast("double").alias(c) for c in ("K_lower", "K_upper", "L_lower", "L_upper")])
    n = points.select("x", "y").dropna().count()
    pairs = random_pair_counts(points.sparkSession, n, distances, bbox, simulations, seed)
    k = pairs.select("sim", "distance", (F.col("pairs") * area / F.lit(float(n * (n - 1)))).alias("K"))
    both = k.withColumn("L", F.sqrt(F.col("K") / math.pi) - F.col("distance"))
    ends = both.groupBy("distance").agg(F.min("K").alias("K_lower"), F.max("K").alias("K_upper"), F.min("L").alias("L_lower"), F.max("L").alias("L_upper"))
    return own.join(ends, "distance")


STATIONARITY = "adf_statistic double, adf_p_value double, adf_stationary boolean, kpss_statistic double, kpss_p_value double, kpss_stationary boolean, verdict string"


def stationarity(cube: DataFrame, min_total: float = 5) -> DataFrame:
    """ADF and KPSS of each active cell's series, with a verdict; sorted by verdict and cell. A task's cells are tested together."""

    def run(batches):
        for pdf in batches:
            for rows, x in by_length(pdf):
                yield pd.concat([rows[["row", "col"]].reset_index(drop=True), pd.DataFrame(numerics.stationarity_many(x))], axis=1)

    active = cube.groupBy("row", "col").agg(F.sum("count").alias("total")).where(F.col("total") >= min_total).select("row", "col")
    series = series_of(cube, "row", "col").join(active, ["row", "col"])
    return series.mapInPandas(run, f"row int, col int, {STATIONARITY}").orderBy("verdict", "row", "col")
