"""k-nearest-neighbour search and classification as partitioned Spark jobs.

Every vector is assigned to the cell of its nearest pivot; neighbouring cells are laid
together into bins of bounded size. The exact search has two rounds. In the first a
query meets the vectors of its own cell, which gives k vectors that are truly that
near. In the second the triangle inequality tells which other cells can hold a nearer
one, and the query is sent once to each bin that has such cells. So no neighbour is
ever missed, and a query is copied at most once for each bin, whatever the data.

The approximate search probes the nearest cells only. How many is not guessed: the
exact answers of a sample of the queries say how many cells reach the wanted recall.

Equal vectors share their answer: of the training copies of one vector only the k
smallest ids can be neighbours, and each distinct query vector is searched once.
Neighbours are ordered by distance, then id, so results are repeatable.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.shipping import ship_package
from trafficlens.sources.sinks import cut
from trafficlens.sources.workspace import remove_tree, scratch_path

# share of the vector lengths that covers rounding in distances taken through dot products
_SLACK = 1e-6
# distances held at once inside a task
_PAIRS_AT_ONCE = 1_000_000
# queries, or vectors of a cell, on a side of what is compared at once
_TILE = 1024
# bytes of the vectors in a bin, and of the queries that meet it in one task
_BLOCK_BYTES = 16_000_000
# visits that a routing task sends on at once
_VISITS_AT_ONCE = 8192
# sets the order of the sampled queries apart from that of the pivots
_SAMPLE_SEED = 7919
# a vector's copies are thinned in this many parts before they meet
_COPY_PARTS = 64


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _rows_of(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors of an Arrow column, without an object for each."""
    return np.asarray(pc.list_flatten(vectors), dtype=np.float64).reshape(len(vectors), -1)


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(squares, 0.0)


def _row_slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, _PAIRS_AT_ONCE // max(width, 1))
    return (slice(i, i + step) for i in range(0, rows, step))


def _pivot_count(vectors: int, dims: int, max_pivots: int) -> int:
    """About the square root of the vectors, bounded so that the pivots (64 MB) fit anywhere."""
    bound = min(max_pivots, 8_000_000 // max(dims, 1))
    return max(1, min(bound, math.isqrt(max(vectors, 1) - 1) + 1))


@dataclass(frozen=True)
class Cells:
    """What routing needs to know of every cell; a few numbers for each pivot.

    A cell lies in ``blocks`` bins from ``bin`` on: several if it is larger than a bin, and
    else in one together with cells near it.
    """

    pivots: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    members: np.ndarray
    bin: np.ndarray
    blocks: np.ndarray


def _laid_out(pivots: np.ndarray, members: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each cell.

    Small cells are taken in the order of a walk that goes to the nearest pivot left.
    """
    bins, blocks, used = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), 0
    left, here = set(range(len(pivots))), 0
    room = 0
    while left:
        rest = np.fromiter(left, np.int64, len(left))
        here = int(rest[_squared_distances(pivots[here : here + 1], pivots[rest])[0].argmin()])
        left.remove(here)
        if members[here] > block_rows:
            blocks[here] = -(-members[here] // block_rows)
            bins[here], used, room = used, used + blocks[here], 0
        else:
            if members[here] > room:
                used, room = used + 1, block_rows
            bins[here] = used - 1
            room -= members[here]
    return bins, blocks


def _assigner(pivots):
    """Vector -> (nearest pivot, distance to it)."""

    @F.pandas_udf("cell int, radius double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        x, p = _matrix(vectors), pivots.value
        cell = np.concatenate(
            [_squared_distances(x[s], p).argmin(1) for s in _row_slices(len(x), len(p))]
        )
        radius = np.sqrt(((x - p[cell]) ** 2).sum(1))
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": radius})

    return assign


def _own_cells(d: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """For each query the nearest cells that together have k vectors, as a mask."""
    order = np.argsort(d, axis=1, kind="stable")
    before = np.cumsum(members[order], axis=1) - members[order]
    mask = np.zeros(d.shape, bool)
    np.put_along_axis(mask, order, before < k, 1)
    return mask


def _nearest_cells(d: np.ndarray, probes: int) -> np.ndarray:
    mask = np.zeros(d.shape, bool)
    np.put_along_axis(mask, np.argsort(d, axis=1, kind="stable")[:, :probes], True, 1)
    return mask


def _least_distances(x: np.ndarray, d: np.ndarray, cells: Cells, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what every vector of a cell is at least away from a query, room for rounding).

    By the spheres around a pivot between which its cell lies, and by the plane halfway
    between a cell's pivot and the query's; ``between`` are the distances of the pivots.
    """
    reach = np.sqrt((cells.pivots * cells.pivots).sum(1)).max() + cells.outer.max()
    slack = (_SLACK * (np.sqrt((x * x).sum(1)) + reach))[:, None]
    own = d.argmin(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d * d - d.min(1, keepdims=True) ** 2) / (2.0 * between[own])
    plane = np.where(between[own] > slack, plane, 0.0)
    # rounding grows when the two pivots are close, hence the wider margin
    margin = slack * np.where(between[own] > slack, 2.0 + 2.0 * d / np.maximum(between[own], slack), 2.0)
    return np.maximum(np.maximum(d - cells.outer, cells.inner - d), plane - margin), slack


_VISITS = "qid long, features array<double>, kth double, bin int, cells array<int>"


def _grouped(mask: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, bin, first, cells): a row for each query and bin of its cells; they begin at ``first`` in ``cells``."""
    query, cell = np.nonzero(mask)
    n = cells.blocks[cell]
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    query, cell = np.repeat(query, n), np.repeat(cell, n)
    bins = cells.bin[cell] + block
    order = np.lexsort((bins, query))
    query, bins, cell = query[order], bins[order], cell[order]
    first = np.flatnonzero(np.diff(query, prepend=-1) | np.diff(bins, prepend=-1))
    return query[first], bins[first], np.append(first, len(cell)), cell


def _router(layout, choose):
    """Queries (qid, features, kth) -> ``_VISITS``: the bins of the cells that ``choose`` takes, with these."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = layout.value
        between = np.sqrt(_squared_distances(cells.pivots, cells.pivots))
        for batch in batches:
            if not batch.num_rows:
                continue
            qid, features, kth = (batch.column(name) for name in ("qid", "features", "kth"))
            x, limit = _rows_of(features), np.sqrt(np.asarray(kth, dtype=np.float64))
            for s in _row_slices(len(x), len(cells.pivots)):
                d = np.sqrt(_squared_distances(x[s], cells.pivots))
                query, bins, first, asked = _grouped(choose(x[s], d, limit[s], cells, between), cells)
                for i in range(0, len(query), _VISITS_AT_ONCE):
                    j = min(i + _VISITS_AT_ONCE, len(query))
                    own = pa.array(s.start + query[i:j])
                    ends = pa.array(first[i : j + 1] - first[i], pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(asked[first[i] : first[j]], pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [qid.take(own), features.take(own), kth.take(own), pa.array(bins[i:j], pa.int32()), lists],
                        names=["qid", "features", "kth", "bin", "cells"],
                    )

    return route


def _first_cells(k: int, probes: int | None = None):
    """The cells to meet first: a query's own, or the ``probes`` nearest."""

    def choose(x, d, limit, cells, between):
        return _nearest_cells(d, probes) if probes else _own_cells(d, cells.members, k)

    return choose


def _second_cells(k: int):
    """The other cells that can have a vector nearer than the k-th so far."""

    def choose(x, d, limit, cells, between):
        least, slack = _least_distances(x, d, cells, between)
        return (least <= limit[:, None] + 2.0 * slack) & ~_own_cells(d, cells.members, k)

    return choose


def _exactly(q, t, row, column) -> np.ndarray:
    """Squared distances of the pairs (row of q, row of t)."""
    step = max(1, _PAIRS_AT_ONCE // max(q.shape[1], 1))
    parts = [((q[row[i : i + step]] - t[column[i : i + step]]) ** 2).sum(1) for i in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _first_of(row, exact, column, k: int):
    """The k nearest of each row's candidates; ``column`` is in the order of ids."""
    order = np.lexsort((column, exact, row))
    row, exact, column = row[order], exact[order], column[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[best], exact[best], column[best]


def _best_of(q, limit, asked, t, place, starts, k: int):
    """(row of q, squared, place) of the k nearest vectors in the cells that each row asks for.

    ``limit``: a squared distance beyond which a row needs none. ``asked``: rows by cells.
    The cells are the parts of t from ``starts`` on; ``place`` is a vector's place in the
    order of ids. At most a tile of distances is held, and k candidates of a tile for each
    row, until there are enough to thin them.
    """
    q_squares, t_squares = (q * q).sum(1), (t * t).sum(1)
    room = 1e-11 * (q_squares + t_squares.max())
    limit = limit + room
    kept, held = [], 0

    def thinned():
        return _first_of(*map(np.concatenate, zip(*kept, strict=True)), k)

    for c, (begin, end) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        rows = np.flatnonzero(asked[:, c])
        for a in range(begin, end if len(rows) else begin, _TILE):
            b = min(a + _TILE, end)
            rough = q[rows] @ t[a:b].T
            rough *= -2.0
            rough += q_squares[rows, None]
            rough += t_squares[a:b]
            near = rough <= (limit[rows] + room[rows])[:, None]
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
            if len(many):
                kth = np.partition(rough[many], k - 1, axis=1)[:, k - 1]
                limit[rows[many]] = np.minimum(limit[rows[many]], kth + room[rows[many]])
                near[many] = rough[many] <= (limit[rows[many]] + room[rows[many]])[:, None]
            row, column = np.nonzero(near)
            if not len(row):
                continue
            row, column = rows[row], column + a
            kept.append(_first_of(row, _exactly(q, t, row, column), place[column], k))
            held += len(kept[-1][0])
            if held > max(_PAIRS_AT_ONCE, 2 * k * len(q)):
                kept = [thinned()]
                row, exact, _ = kept[0]
                held = len(row)
                last = np.flatnonzero(np.diff(row, append=-1))
                full = last[np.bincount(row, minlength=len(q))[row[last]] == k]
                limit[row[full]] = np.minimum(limit[row[full]], exact[full] + room[row[full]])
    return thinned() if kept else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))


def _best_in_bin(k: int):
    """Compare a block of queries with the cells of a bin that each of them asks for."""

    def compare(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and vectors.num_rows:
            by_id = np.asarray(pc.sort_indices(vectors["id"], null_placement="at_start")).astype(np.int64)
            place = np.empty(len(by_id), np.int64)
            place[by_id] = np.arange(len(by_id))
            cell = np.asarray(vectors["cell"])
            order = np.argsort(cell, kind="stable")
            t, place = _rows_of(vectors["features"])[order], place[order]
            present, starts = np.unique(cell[order], return_index=True)
            starts = np.append(starts, len(order))
            q, limit = _rows_of(queries["features"]), np.asarray(queries["kth"])
            lengths = np.asarray(pc.list_value_length(queries["cells"])).astype(np.int64)
            wanted, ends = np.asarray(pc.list_flatten(queries["cells"])), np.append(0, np.cumsum(lengths))
            for i in range(0, len(q), _TILE):
                n = min(_TILE, len(q) - i)
                own = wanted[ends[i] : ends[i + n]]
                at = np.minimum(np.searchsorted(present, own), len(present) - 1)
                # a cell larger than a bin may have none of its vectors here
                here = present[at] == own
                asked = np.zeros((n, len(present)), bool)
                asked[np.repeat(np.arange(n), lengths[i : i + n])[here], at[here]] = True
                row, exact, nth = _best_of(q[i : i + n], limit[i : i + n], asked, t, place, starts, k)
                found.append((row + i, exact, by_id[nth]))
        empty = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        row, exact, index = map(np.concatenate, zip(empty, *found, strict=True))
        chosen = vectors.select(["id", "label", "cell"]).take(pa.array(index))
        return pa.table({
            "qid": queries["qid"].take(pa.array(row)), "squared": exact,
            "id": chosen["id"], "label": chosen["label"], "cell": chosen["cell"],
        })

    return compare


@dataclass
class Index:
    """Vectors in bins, and their cells; made by ``build_index`` and to be closed."""

    placed: DataFrame
    cells: Cells
    layout: object
    k: int
    block_rows: int
    folder: str

    def close(self) -> None:
        """Remove the stored vectors and what was sent to the executors."""
        self.layout.destroy()
        remove_tree(self.placed.sparkSession, self.folder)


@dataclass(frozen=True)
class Probing:
    """How the approximate search was set: cells probed of how many, recall of the sample, its size."""

    probes: int
    cells: int
    recall: float
    sampled: int


def _sound(features: str) -> Column:
    vector = F.col(features).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def build_index(
    train: DataFrame,
    k: int,
    id_column: str = "id",
    features: str = "features",
    label: str = "label",
    max_pivots: int = 1024,
    block_rows: int = 65_536,
) -> Index:
    """Vectors in cells and bins, for searches of up to ``k`` neighbours.

    Null vectors, vectors with a null or non-finite component, and those shorter than the
    longest take no part. A bin has at most ``block_rows`` vectors, fewer if they are long.
    """
    spark = train.sparkSession
    ship_package(spark)
    folder = scratch_path(spark, "knn")
    vector = F.col(features).cast("array<double>").alias("features")
    train = train.filter(_sound(features))
    longest = train.agg(F.max(F.size(features))).first()[0]
    if longest is None:
        raise ValueError("no training vectors")
    # of equal vectors the k smallest ids, thinned in parts first: one vector may be very common
    rows = train.filter(F.size(features) == longest).select(
        F.col(id_column).alias("id"), F.col(label).alias("label"), vector
    )
    part = F.pmod(F.xxhash64("id"), F.lit(_COPY_PARTS))
    for keys in (("features", part), ("features",)):
        copy = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        rows = rows.withColumn("copy", copy).filter(F.col("copy") <= k)
    rows = cut(rows, f"{folder}/vectors")
    distinct = rows.filter(F.col("copy") == 1)

    # pivots: a uniform pick by hash, the same one on every run
    wanted = _pivot_count(distinct.count(), longest, max_pivots)
    picked = distinct.orderBy(F.xxhash64("features"), "features").limit(wanted)
    pivots = np.array([r["features"] for r in picked.select("features").collect()], dtype=np.float64)
    sent = spark.sparkContext.broadcast(pivots)
    placed = rows.select("id", "label", "features", _assigner(sent)("features").alias("place"))
    placed = cut(placed.select("id", "label", "features", "place.cell", "place.radius"), f"{folder}/cells")
    sent.destroy()

    # three numbers for each pivot
    inner, outer, members = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in placed.groupBy("cell").agg(F.min("radius"), F.max("radius"), F.count("*")).collect():
        inner[r[0]], outer[r[0]], members[r[0]] = r[1], r[2], r[3]
    block_rows = max(1, min(block_rows, _BLOCK_BYTES // (8 * max(longest, 1))))
    first, blocks = _laid_out(pivots, members, block_rows)
    cells = Cells(pivots, inner, outer, members, first, blocks)
    where = [(i, int(b), int(n)) for i, (b, n) in enumerate(zip(first, blocks, strict=True))]
    table = spark.createDataFrame(where, "cell int, first int, blocks int")
    bin_ = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    placed = placed.join(F.broadcast(table), "cell").select("id", "label", "features", "cell", bin_.alias("bin"))
    return Index(cut(placed, f"{folder}/bins"), cells, spark.sparkContext.broadcast(cells), k, block_rows, folder)


def _met(index: Index, visits: DataFrame) -> DataFrame:
    """(qid, squared, id, label, cell): up to k rows for each query and bin it visits.

    visits: ``_VISITS``, each row a query for one bin; ``kth`` is a squared distance beyond
    which the query needs no vector. A bin with many visitors is compared in several
    tasks, each with a block of them.
    """
    n = F.ceil(F.count("*") / index.block_rows).cast("int").alias("query_blocks")
    crowds = visits.groupBy("bin").agg(n)
    own_block = F.pmod(F.xxhash64("qid"), F.col("query_blocks")).cast("int").alias("query_block")
    left = visits.join(crowds, "bin").select("bin", own_block, "qid", "features", "kth", "cells")
    every_block = F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block")
    right = index.placed.join(crowds, "bin").select("bin", every_block, "id", "label", "features", "cell")
    schema = T.StructType([
        T.StructField("qid", T.LongType()),
        T.StructField("squared", T.DoubleType()),
        T.StructField("id", index.placed.schema["id"].dataType),
        T.StructField("label", index.placed.schema["label"].dataType),
        T.StructField("cell", T.IntegerType()),
    ])
    pair = ["bin", "query_block"]
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_best_in_bin(index.k), schema)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("squared", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _asked(index: Index, queries: DataFrame, features: str) -> DataFrame:
    """Distinct sound query vectors with a number; written, so that numbers stay."""
    queries = queries.filter(_sound(features) & (F.size(features) == index.cells.pivots.shape[1]))
    distinct = queries.select(F.col(features).cast("array<double>").alias("features")).distinct()
    numbered = distinct.select(F.monotonically_increasing_id().alias("qid"), "features")
    return cut(numbered, f"{index.folder}/asked-{uuid.uuid4().hex}")


def first_visits(index: Index, asked: DataFrame, probes: int | None = None) -> DataFrame:
    """``_VISITS`` of the first round, or of the only one with ``probes``."""
    queries = asked.select("qid", "features", F.lit(float("inf")).alias("kth"))
    return queries.mapInArrow(_router(index.layout, _first_cells(index.k, probes)), _VISITS)


def second_visits(index: Index, asked: DataFrame, first: DataFrame) -> DataFrame:
    """The same of the second round, after the neighbours that the ``first`` found."""
    known = first.groupBy("qid").agg(F.count("*").alias("n"), F.max("squared").alias("kth"))
    limit = F.when(F.col("n") >= index.k, F.col("kth")).otherwise(float("inf"))
    queries = asked.join(known, "qid").select("qid", "features", limit.alias("kth"))
    return queries.mapInArrow(_router(index.layout, _second_cells(index.k)), _VISITS)


def search(index: Index, asked: DataFrame, probes: int | None = None) -> DataFrame:
    """(qid, squared, id, label, cell, rank) of the k nearest, exactly unless ``probes`` are given."""
    first = _best(_met(index, first_visits(index, asked, probes)), index.k)
    if probes:
        return first
    first = cut(first, f"{index.folder}/first-{uuid.uuid4().hex}").drop("rank")
    second = _met(index, second_visits(index, asked, first))
    return _best(first.unionByName(second), index.k)


def probes_for(index: Index, queries: DataFrame, recall: float, sample: int = 256) -> Probing:
    """The fewest cells to probe so that a sample of the queries finds that share of its true neighbours.

    ``sample`` distinct queries, the first by hash, are answered exactly; the place of each
    true neighbour's cell in the query's order of cells tells what every number of
    probes would find. The hash is another one than that of the pivots: a pivot lies in the
    middle of its own cell and finds more there than other queries do.
    """
    few = queries.orderBy(F.xxhash64("features", F.lit(_SAMPLE_SEED)), "features").limit(sample)
    few = cut(few, f"{index.folder}/sample-{uuid.uuid4().hex}")
    found = search(index, few).join(few, "qid").select("qid", "features", "cell").toPandas()
    d = np.sqrt(_squared_distances(_matrix(found["features"]), index.cells.pivots))
    order = np.argsort(d, axis=1, kind="stable")
    place = (order == found["cell"].to_numpy()[:, None]).argmax(1)
    share = np.cumsum(np.bincount(place, minlength=d.shape[1])) / len(place)
    probes = int(np.searchsorted(share, min(recall, 1.0) - 1e-12)) + 1
    return Probing(probes, d.shape[1], float(share[probes - 1]), int(found["qid"].nunique()))


def _neighbours(asked: DataFrame, rows: DataFrame) -> DataFrame:
    neighbour = F.struct("rank", F.sqrt("squared").alias("distance"), "id", "label")
    found = rows.groupBy("qid").agg(F.sort_array(F.collect_list(neighbour)).alias("neighbours"))
    plain = F.transform(
        "neighbours",
        lambda n: F.struct(n["distance"].alias("distance"), n["id"].alias("id"), n["label"].alias("label")),
    )
    return asked.join(found, "qid").select("features", plain.alias("neighbours"))


def nearest_vectors(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    features: str = "features",
    recall: float | None = None,
    **options,
) -> DataFrame:
    """(features, neighbours) per distinct query vector, nearest first.

    ``neighbours`` is an array of up to k (distance, id, label). Null vectors, vectors
    with a null or non-finite component, and those of another length than the training
    vectors' greatest one take no part. With ``recall`` (0 to 1) the search is approximate
    and set to find that share; without, it is exact. Other options are those of
    ``build_index``. This is an action: it runs jobs, and its result is a table in the
    shared scratch folder; everything else that it stored is removed.
    """
    found, _ = nearest_with_report(train, queries, k, features, recall, **options)
    return found


def nearest_with_report(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    features: str = "features",
    recall: float | None = None,
    **options,
) -> tuple[DataFrame, Probing | None]:
    """``nearest_vectors`` and how an approximate search was set."""
    index = build_index(train, k, features=features, **options)
    try:
        asked = _asked(index, queries, features)
        probing = None
        if recall is not None and not asked.isEmpty():
            probing = probes_for(index, asked, recall)
        rows = search(index, asked, probing.probes if probing else None)
        return cut(_neighbours(asked, rows), scratch_path(train.sparkSession, "neighbours")), probing
    finally:
        index.close()


def majority(neighbours: Column, k: int) -> Column:
    """Most common label of the first k neighbours; the smallest label wins a tie."""
    labels = F.transform(F.slice(neighbours, 1, k), lambda n: n["label"])
    votes = F.transform(
        F.array_distinct(labels),
        lambda l: F.struct(
            (-F.size(F.filter(labels, lambda other: other == l))).alias("votes"), l.alias("label")
        ),
    )
    return F.array_min(votes)["label"]


def classify(
    train: DataFrame, queries: DataFrame, ks: Sequence[int] = (5,), **options
) -> DataFrame:
    """``queries`` plus one ``prediction_<k>`` column per k, from a single search."""
    features = options.get("features", "features")
    found = nearest_vectors(train, queries, max(ks), **options)
    return _join_back(queries, found, features).select(
        *queries.columns, *[majority(F.col("neighbours"), k).alias(f"prediction_{k}") for k in ks]
    )


def classify_others(points: DataFrame, ks: Sequence[int] = (5,), **options) -> DataFrame:
    """Each row classified by its nearest other rows."""
    features, id_column = options.get("features", "features"), options.get("id_column", "id")
    found = nearest_vectors(points, points, max(ks) + 1, **options)
    others = F.filter("neighbours", lambda n: n["id"] != F.col(id_column))
    return (
        _join_back(points, found, features)
        .withColumn("neighbours", others)
        .select(
            *points.columns,
            *[majority(F.col("neighbours"), k).alias(f"prediction_{k}") for k in ks],
        )
    )


def _join_back(rows: DataFrame, found: DataFrame, features: str) -> DataFrame:
    """Attach each row's answer; answers are unique, so adaptive skew splitting of the
    row side is enough when one vector has very many copies. A row whose vector took no
    part stays, without neighbours."""
    answers = found.withColumnRenamed("features", "_vector")
    same = F.col(features).cast("array<double>") == F.col("_vector")
    return rows.join(answers, same, "left").drop("_vector")
