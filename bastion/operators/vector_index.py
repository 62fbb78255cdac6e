"""V6: a persisted inverted index over vectors, searched with proven bounds.

``build_index`` trains a coarse quantiser (Spark ML k-means on a bounded hash sample of unit vectors), files every vector
under its key (namespace) and nearest cell, and stores it next to an 8-bit code of its direction and the exact length
of what the code leaves out. The files are partitioned by key and cell, so a search reads only the cells it probes, and of
these first the codes (an eighth of the bytes) and only then the few vectors that can still be among the k best.

A search takes the cells of a key in shelves of neighbouring cells (``SHELF_ROWS`` items): a query travels once to each shelf that
it probes, with a bit per cell, never once per cell.

``search_index`` works in rounds that never make a (query, item) pair a row unless the item may belong to the answer:

1. every query probes its ``near`` nearest cells; codes give a lower and an upper bound of each score, and the
   k-th best lower bound of a query is its floor, which rises while a shelf is read;
2. the other cells of its keys are probed only if the best score that their spread allows reaches the floor;
3. items whose upper bound reaches the floor are scored exactly (V4) and ranked.

The result then equals the exhaustive search of V5. With ``probes`` a query stops after so many cells per key: faster and
approximate, no longer proven. Vectors that are NULL, empty or all zero score 0 (V4) and lie in a cell of their own;
vectors of another length than the index's lie in another one, whose items are always scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .vectors import cosine

#: Cells of vectors without a direction and of another length.
FLAT, ODD = -1, -2
#: Scores are ranked after rounding to 6 digits: bounds may miss each other by that much.
SLACK = 2e-6
#: Vectors a cell holds on average, cells at most, and training rows per cell.
CELL_ROWS, MOST_CELLS, TRAIN_ROWS = 256, 4096, 256
#: Items of a shelf; a cell of several blocks is a shelf of its own.
SHELF_ROWS = 50_000


@dataclass
class VectorIndex:
    """A built index: where it lies, its vectors' length and its unit cell centres (MOST_CELLS x dim numbers at most)."""

    path: str
    dim: int
    centres: np.ndarray

    def items(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id long, code binary, step double, rest double, twin long, vec array<double>, block int, key string, cell int").parquet(f"{self.path}/items")

    def cells(self, spark: SparkSession) -> DataFrame:
        """(key, cell, n, blocks, spread): items, blocks and the least cosine to the centre of every cell."""
        return spark.read.schema("key string, cell int, n long, blocks int, spread double").parquet(f"{self.path}/cells")


def _unit(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (zero where there is none), whether a row has a direction, and whether it has another length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out, right = np.zeros((len(column), dim)), np.flatnonzero((length == dim) & (length > 0))
    if right.size:
        out[right] = column.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.linalg.norm(out, axis=1)
    fine = norm > 0
    out[fine] /= norm[fine, None]
    return out, fine, (length > 0) & (length != dim)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes of unit vectors, the value of one step, and the length of what the code leaves out."""
    step = np.abs(unit).max(axis=1, initial=0) / 127
    code = np.rint(np.divide(unit, step[:, None], out=np.zeros_like(unit), where=step[:, None] > 0)).astype(np.int8)
    return code, step, np.linalg.norm(unit - code * step[:, None], axis=1)


def _train(items: DataFrame, dim: int, cells: int, count: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(2.0 ** 53)
    usable = items.where((F.size("vec") == dim) & F.exists("vec", lambda x: x != 0) & (draw < min(1.0, cells * TRAIN_ROWS / max(count, 1))))
    if cells < 2 or usable.isEmpty():
        return np.ones((1, dim)) / np.sqrt(dim)
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(usable.select(array_to_vector("vec").alias("features")))
    centres = np.array(model.clusterCenters())
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres[norm[:, 0] > 0] / norm[norm[:, 0] > 0]


def build_index(items: DataFrame, path: str, dim: int, *, i_id: str, i_key: str, i_vec: str = "vec", cells: int | None = None,
                block_rows: int = 50_000, seed: int = 7) -> VectorIndex:
    """Write the index of ``items`` (integral id, key, vector) below ``path`` (overwritten)."""
    spark = items.sparkSession
    rows = items.select(F.col(i_id).cast("long").alias("id"), F.col(i_vec).cast("array<double>").alias("vec"), F.col(i_key).cast("string").alias("key"))
    count = rows.count()
    centres = _train(rows, dim, cells or min(MOST_CELLS, max(1, count // CELL_ROWS)), count, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, fine, odd = _unit(batch.column(1), dim)
            code, step, rest = encode(unit)
            near = unit @ centres.T
            cell = np.where(odd, ODD, np.where(fine, near.argmax(axis=1), FLAT)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(rest), pa.array(cell), pa.array(near.max(axis=1))],
                ["id", "vec", "key", "code", "step", "rest", "cell", "near"])

    coded = rows.mapInArrow(run, "id long, vec array<double>, key string, code binary, step double, rest double, cell int, near double")
    sizes = coded.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("spread"))
    sizes.select("key", "cell", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), "spread").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    index = VectorIndex(path, dim, centres)
    blocks = F.broadcast(index.cells(spark).select("key", "cell", "blocks"))  # keys are few, cells at most MOST_CELLS + 2
    placed = coded.join(blocks, ["key", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    placed = placed.withColumn("twin", F.xxhash64("vec"))  # equal vectors have one
    (placed.select("id", "code", "step", "rest", "twin", "vec", "block", "key", "cell").repartition("key", "cell", "block")
     .write.mode("overwrite").partitionBy("key", "cell").parquet(f"{path}/items"))
    return index


# ---------------------------------------------------------------------------
# Search
# ---------------------------------------------------------------------------


def reachable(q: np.ndarray, centres: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """(queries x cells) the best cosine that a vector of the cell can have, by the angles to the centre."""
    angle = np.arccos(np.clip(q @ centres.T, -1, 1)) - np.arccos(np.clip(spread, -1, 1))[None, :]
    return np.cos(np.maximum(angle, 0)) + 1e-9


def _neighbours(centres: np.ndarray) -> np.ndarray:
    """An order of the centres in which near ones stand together: halved again and again along the widest direction."""
    todo, out = [np.arange(len(centres))], []
    while todo:
        at = todo.pop()
        if len(at) < 3:
            out.append(at)
            continue
        moved = centres[at] - centres[at].mean(axis=0)
        at = at[np.argsort(moved @ np.linalg.eigh(moved.T @ moved)[1][:, -1], kind="stable")]
        todo += [at[len(at) // 2:], at[:len(at) // 2]]
    return np.concatenate(out) if out else np.zeros(0, int)


def _shelved(stats: pd.DataFrame, centres: np.ndarray, shelf_rows: int) -> pd.DataFrame:
    """The cells (key, cell, n, blocks, spread) with their shelf of the key and their place on it."""
    turn = np.empty(len(centres), int)
    turn[_neighbours(centres)] = np.arange(len(centres))
    out = stats.assign(turn=[turn[c] if c >= 0 else c for c in stats["cell"]]).sort_values(["key", "turn"], ignore_index=True)
    shelf, place, held, last = [], [], 0, None
    for row in out.itertuples():
        alone = row.blocks > 1 or row.cell < 0
        if row.key != last:
            shelf.append(0)
            place.append(0)
        elif alone or held + row.n > shelf_rows:
            shelf.append(shelf[-1] + 1)
            place.append(0)
        else:
            shelf.append(shelf[-1])
            place.append(place[-1] + 1)
        held = shelf_rows if alone else row.n + (held if place[-1] else 0)
        last = row.key
    return out.assign(shelf=shelf, place=place).drop(columns="turn").astype({"shelf": "int32", "place": "int32"})


#: Directions are cut to multiples of 1 / GRID: products then add up exactly, in any order, so both rounds agree on the nearest cells.
GRID = float(2 ** 24)


def _probes(index: VectorIndex, cells: pd.DataFrame, near: int, later: bool, max_cells: int = 1_000_000):
    """Kernel: the shelves that each query row probes, with a bit per cell: the nearest cells or, by its floor, the others."""
    by_key = [(k, f.reset_index(drop=True)) for k, f in cells.groupby("key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, fine, _ = _unit(batch.column("__qv"), index.dim)
            floor, of = batch.column("floor").to_numpy(), np.array(batch.column("key").to_pylist(), object)
            for key, mine in by_key:
                cell, at = mine["cell"].to_numpy(), np.flatnonzero(of == key)
                real, few = cell >= 0, min(near, len(cell))
                centres, spread = index.centres[cell[real]], mine["spread"].to_numpy()[real]
                for rows in (at[k:k + max(1, max_cells // len(cell))] for k in range(0, len(at), max(1, max_cells // len(cell)))):
                    score = np.zeros((len(rows), len(cell)))
                    score[:, cell == ODD] = 2 * GRID * GRID
                    score[:, real] = np.rint(unit[rows] * GRID) @ np.rint(centres * GRID).T
                    first = np.argpartition(-score, few - 1, axis=1)[:, :few]
                    take = np.zeros(score.shape, bool)
                    if later:
                        best = np.zeros(score.shape)
                        best[:, real] = np.where(fine[rows, None], reachable(unit[rows], centres, spread), 0.0)
                        best[:, cell == ODD] = 1.0
                        take = best >= floor[rows, None] - SLACK
                    np.put_along_axis(take, first, not later, axis=1)
                    for shelf, held in mine.groupby("shelf"):
                        bits = take[:, held.index]
                        asks = np.flatnonzero(bits.any(axis=1))
                        if asks.size:
                            mine_ = pa.array(rows[asks])
                            yield pa.RecordBatch.from_arrays([
                                batch.column("__q").take(mine_), batch.column("__qv").take(mine_), batch.column("floor").take(mine_),
                                pa.array([key] * len(asks), pa.string()), pa.array(np.full(len(asks), shelf, np.int32)),
                                pa.array(np.full(len(asks), held["blocks"].max(), np.int32)),
                                pa.array([x.tobytes() for x in np.packbits(bits[asks], axis=1)], pa.binary())],
                                ["__q", "__qv", "floor", "key", "shelf", "blocks", "bits"])

    return run


def _bounds(dim: int, k: int, exclude_self: bool, max_cells: int = 500_000):
    """Kernel: of one block of a shelf, the items that can be among a query's k best, with bounds of their scores."""

    def best(found: list, floor: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of (query row, item, lower, upper) those that reach their row's floor, which first rises to the k-th best lower bound."""
        row, item, lower, upper = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-lower, row))
        row, item, lower, upper = row[order], item[order], lower[order], upper[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        full = starts[np.diff(np.r_[starts, len(row)]) >= k]
        floor[row[full]] = np.maximum(floor[row[full]], lower[full + k - 1])
        keep = upper >= floor[row] - SLACK
        return row[keep], item[keep], lower[keep], upper[keep]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            # of items with one vector only those with the smallest ids can be among the k best, whoever asks
            items = held.drop_columns("code").to_pandas()
            items["at"] = np.arange(len(items))
            items = items.sort_values(["place", "twin", "step", "rest", "id"], ignore_index=True)
            nth = items.groupby(["place", "twin", "step", "rest"], dropna=False)["id"].rank("dense")
            items = items[nth <= k + exclude_self]
            codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.int8).reshape(-1, dim)[items["at"].to_numpy()]
            step, rest, ids, cell, place = (items[c].to_numpy() for c in ("step", "rest", "id", "cell", "place"))
            near, rest = codes * step[:, None], rest + 1e-9
            spans = [(p, *np.searchsorted(place, [p, p + 1])) for p in np.unique(place)]
            rows_at_once = max(1, min(4096, max_cells // max(e - s for _, s, e in spans)))
            for start in range(0, asked.num_rows, rows_at_once):
                part = asked.slice(start, rows_at_once)
                unit, fine, _ = _unit(part["__qv"], dim)
                qid, floor = part["__q"].to_numpy(), part["floor"].to_numpy().copy()
                bits = np.unpackbits(np.frombuffer(b"".join(part["bits"].to_pylist()), np.uint8).reshape(len(qid), -1), axis=1)
                found, many = [], 0
                for p, s, e in spans:
                    rows = np.flatnonzero(bits[:, p])
                    if not rows.size:
                        continue
                    if cell[s] == ODD:
                        lower, upper = np.full((len(rows), e - s), -1.0), np.full((len(rows), e - s), 1.0)
                    elif cell[s] == FLAT:
                        lower = upper = np.zeros((len(rows), e - s))
                    else:
                        middle = unit[rows] @ near[s:e].T
                        gap = np.where(fine[rows, None], rest[None, s:e], 0.0)
                        lower, upper = middle - gap, middle + gap
                    other = qid[rows, None] != ids[None, s:e] if exclude_self else np.ones(lower.shape, bool)
                    new = floor[rows] < -1.5  # no floor yet
                    if new.any() and e - s >= k:
                        kth = np.partition(np.where(other[new], lower[new], -np.inf), e - s - k, axis=1)[:, e - s - k]
                        floor[rows[new]] = np.maximum(floor[rows[new]], kth)
                    r, c = np.nonzero((upper >= floor[rows, None] - SLACK) & other)
                    found.append((rows[r], s + c, lower[r, c], upper[r, c]))
                    many += len(r)
                    if many > max_cells:
                        found = [best(found, floor)]
                        many = len(found[0][0])
                        many = 0 if many > max_cells // 2 else many  # ties that stay: not sorted again at once
                if found:
                    row, item, lower, upper = best(found, floor)
                    out.append(pa.table({"__q": qid[row], "__i": ids[item], "lower": lower, "upper": upper}))
        return pa.concat_tables(out) if out else pa.table({"__q": pa.array([], pa.int64()), "__i": pa.array([], pa.int64()),
                                                           "lower": pa.array([], pa.float64()), "upper": pa.array([], pa.float64())})

    return run


def candidates(queries: DataFrame, index: VectorIndex, k: int, *, near: int = 4, probes: int | None = None, exclude_self: bool = False,
               query_block_rows: int = 20_000, shelf_rows: int = SHELF_ROWS) -> DataFrame:
    """(__q, __i, lower, upper) of all items that can be among the k best of rows (__q, __qv, key)."""
    spark = queries.sparkSession
    stats = index.cells(spark).where("key IS NOT NULL").toPandas()  # a row per key and cell: keys are few, cells at most MOST_CELLS + 2
    stats = _shelved(stats, index.centres, shelf_rows)
    shelves = F.broadcast(spark.createDataFrame(stats[["key", "cell", "shelf", "place"]], "key string, cell int, shelf int, place int"))
    items = index.items(spark).select("id", "code", "step", "rest", "twin", "key", "cell", "block").join(shelves, ["key", "cell"])
    first = min(near, probes) if probes else near

    def scan(asked: DataFrame) -> DataFrame:
        many = asked.groupBy("key", "shelf").agg(F.ceil(F.count(F.lit(1)) / query_block_rows).cast("int").alias("qblocks"))
        side = (asked.join(F.broadcast(many), ["key", "shelf"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                .withColumn("qblock", F.pmod(F.xxhash64("__q"), "qblocks").cast("int"))
                .select("__q", "__qv", "floor", "bits", "key", "shelf", "block", "qblock"))
        held = (items.join(F.broadcast(many), ["key", "shelf"]).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
                .drop("qblocks"))
        keys = ["key", "shelf", "block", "qblock"]
        return side.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(
            _bounds(index.dim, k, exclude_self), "__q long, __i long, lower double, upper double")

    def floors(found: DataFrame) -> DataFrame:
        rank = Window.partitionBy("__q").orderBy(F.col("lower").desc())
        return found.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select("__q", F.col("lower").alias("floor"))

    plan = "__q long, __qv array<double>, floor double, key string, shelf int, blocks int, bits binary"
    cols = ["__q", "__qv", "key", "floor"]
    open_rows = queries.withColumn("floor", F.lit(-2.0)).select(*cols)
    if probes:
        return scan(open_rows.mapInArrow(_probes(index, stats, probes, False), plan))
    # what a round has found is kept: floors, later rounds and the answer read it again
    found = materialize(scan(open_rows.mapInArrow(_probes(index, stats, first, False), plan)))
    known = queries.join(floors(found), "__q", "left").fillna({"floor": -2.0}).select(*cols)
    found = found.union(materialize(scan(known.mapInArrow(_probes(index, stats, first, True), plan))))
    least = floors(found)
    return found.join(least, "__q", "left").where(F.col("upper") >= F.coalesce("floor", F.lit(-2.0)) - SLACK).drop("floor")


def search_index(queries: DataFrame, index: VectorIndex, k: int, *, q_id: str, i_id: str, q_key: str, q_vec: str = "vec", digits: int = 6,
                 **kw) -> DataFrame:
    """Top-k items per query among those of its keys: (q_id, i_id, score, rank), ties by item id.

    A query may come in several rows with different keys. ``kw``: ``near``, ``probes``, ``exclude_self`` of :func:`candidates`.
    """
    spark = queries.sparkSession
    rows = queries.select(F.col(q_id).cast("long").alias("__q"), F.col(q_vec).cast("array<double>").alias("__qv"), F.col(q_key).cast("string").alias("key"))
    found = candidates(rows, index, k, **kw).select("__q", "__i")
    items = index.items(spark).select(F.col("id").alias("__i"), "vec")
    scored = (found.join(items, "__i").join(rows.select("__q", "__qv").dropDuplicates(["__q"]), "__q")
              .withColumn("score", F.round(cosine("__qv", "vec"), digits)))
    rank = Window.partitionBy("__q").orderBy(F.col("score").desc(), F.col("__i"))
    return (scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select(F.col("__q").alias(q_id), F.col("__i").alias(i_id), "score", "rank"))
