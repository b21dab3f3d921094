"""Near-duplicate vectors by neighbour descent.

Equal vectors of one label form a class. Every class starts with the best neighbours
among the classes that fall on the same side of a few random planes. Then lists are
refined: all neighbours of a vector, in both directions, are compared with each other,
and whoever is nearer than the worst on a list takes its place, until lists hardly
change. Every comparison of a block also keeps the links at or above the threshold, as
a star for each connected part, so groups stay connected however short the lists are.

A list full of vectors above the threshold is saturated: it is enlarged to all vectors
of its connected group, compared in square blocks, which gives exact link counts. An
audit compares a sample with all vectors of its label and asks for more planes if links
are missing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.frames import map_batches, stored, temporary
from trafficlens.shipping import ship_package

_PAIR = "a long, b long, sim double, near boolean"


@dataclass(frozen=True)
class Descent:
    """threshold: least cosine of a link. places: length of a list.

    block: vectors that are compared with each other at once. planes: rounds of
    random planes. change: share of list places below which refining ends. audited:
    vectors of each label that the audit compares with all others; recall it asks for;
    tries: rounds of planes it may add.
    """

    threshold: float = 0.98
    places: int = 10
    block: int = 256
    planes: int = 6
    change: float = 0.01
    rounds: int = 5
    audited: int = 200
    recall: float = 0.995
    tries: int = 3


def near_vectors(table: DataFrame, how: Descent = Descent()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label).

    Only vectors with equal, non-null labels and equal lengths are compared. A vector that
    is null, zero, or holds a null or a non-finite component links with nothing, as does a
    row without vec_id; it is its own component and is kept (component_id is null without
    vec_id). n_links counts other rows linked directly. Other columns are ignored; an
    empty table gives an empty result.
    """
    ship_package(table.sparkSession)
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    sound = F.coalesce(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull(),
        F.lit(False),
    )
    kind = F.struct("label", F.size("embedding").alias("dim"))
    keyed = rows.filter(sound).select("vec_id", F.xxhash64(kind).alias("kind"), "embedding")
    with temporary(table):
        classes = stored(
            keyed.groupBy("kind", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "vectors"
        )
        sizes = stored(classes.groupBy("kind").agg(F.count("*").alias("many")), "kinds")
        nodes = classes.join(sizes, "kind").select("node", "kind", "many", "embedding")

        found = stored(_planes(nodes, how, 0), "pairs")
        lists, links = _best(found, how), _near(found)
        for _ in range(how.rounds):
            found = stored(_local_joins(lists, classes, how), "pairs")
            links = stored(links.union(_near(found)).distinct(), "near")
            refined = _best(lists.withColumn("near", F.lit(False)).unionByName(found), how)
            changed = refined.join(lists, ["a", "b"], "left_anti").count()
            lists = refined
            if changed <= how.change * how.places * max(1, classes.count()):
                break
        for tried in range(1, how.tries + 1):
            label = stored(components(links.select("a", "b")), "vector-components")
            if _audited_recall(classes, label, how) >= how.recall or tried == how.tries:
                break
            links = stored(links.union(_near(_planes(nodes, how, tried))).distinct(), "near")

        degree = stored(_exact_degrees(classes, label, how), "degrees")
        of_class = classes.select("kind", "embedding", "node", "n").join(degree, "node", "left")
        placed = of_class.select(
            "kind",
            "embedding",
            (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        )
        placed = stored(placed, "placed", keep=True)
    known = keyed.join(placed, ["kind", "embedding"])
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        known.select("vec_id", "n_links", "component_id")
        .union(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def _planes(nodes: DataFrame, how: Descent, attempt: int) -> DataFrame:
    """Pairs within blocks of vectors on the same side of random planes.

    The more vectors of a kind, the more planes; a side with more than a block of
    vectors is dealt into several at random.
    """

    def sides(batches):
        for batch in batches:
            many, kinds = batch.column("many").to_numpy(), batch.column("kind").to_numpy()
            ids, vectors = batch.column("node").to_numpy(), batch.column("embedding")
            out = []
            for i in range(len(ids)):
                x = vectors[i].values.to_numpy(zero_copy_only=False)
                bits = max(0, int(np.log2(max(1, many[i]) / (how.block / 2))))
                for r in range(how.planes):
                    seed = attempt * how.planes + r
                    normals = _normals(seed, bits, len(x))
                    out.append((ids[i], seed, kinds[i], (normals @ x > 0).tobytes()))
            columns = zip(*out, strict=True) if out else ([],) * 4
            names, types = ("node", "seed", "kind", "side"), (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    seen = map_batches(nodes, sides, "node long, seed int, kind long, side binary")
    keyed = stored(seen.select("node", F.xxhash64("seed", "kind", "side").alias("key")), "sides")
    parts = stored(
        keyed.groupBy("key").agg(F.ceil(F.count("*") / how.block).alias("parts")).select("key", "parts"), "side-sizes"
    )
    dealt = keyed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts"))
    group = F.xxhash64("key", "part").alias("block")
    full = dealt.select("node", group).join(nodes.select("node", "embedding"), "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return _compared(rows, how)

    return full.groupBy("block").applyInPandas(compare, _PAIR)


_NORMALS: dict[tuple[int, int, int], np.ndarray] = {}


def _normals(seed: int, bits: int, dim: int) -> np.ndarray:
    key = (seed, bits, dim)
    if key not in _NORMALS:
        _NORMALS[key] = np.random.default_rng(10_007 * seed + dim).standard_normal((bits, dim))
    return _NORMALS[key]


def _cosines(vectors: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    others = vectors if others is None else others
    lengths = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(others, axis=1)[None, :]
    return (vectors @ others.T) / lengths


def _stars(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each connected part of a block, for members that link."""
    order = np.argsort(ids)
    label = np.empty(len(ids), np.int64)
    label[order] = np.arange(len(ids))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(ids)).min(axis=1))
        if (least == label).all():
            break
        label = least
    root = ids[order][label]
    other = np.flatnonzero(root != ids)
    return ids[other], root[other]


def _compared(rows: pd.DataFrame, how: Descent) -> pd.DataFrame:
    """Of one block: each vector's best neighbours, and its links as stars."""
    ids = rows["node"].to_numpy(np.int64)
    if len(ids) < 2:
        return pd.DataFrame({"a": [], "b": [], "sim": [], "near": []})
    sim = _cosines(np.stack(rows["embedding"].to_list()))
    np.fill_diagonal(sim, -2)
    k = min(how.places, len(ids) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    a = np.repeat(ids, k)
    member, root = _stars(ids, sim >= how.threshold)
    return pd.DataFrame(
        {
            "a": np.concatenate([a, member]),
            "b": np.concatenate([ids[best].ravel(), root]),
            "sim": np.concatenate([np.take_along_axis(sim, best, 1).ravel(), np.ones(len(member))]),
            "near": np.concatenate([np.zeros(len(a), bool), np.ones(len(member), bool)]),
        }
    )


def _best(found: DataFrame, how: Descent) -> DataFrame:
    """(a, b, sim): the ``places`` nearest b of each a."""
    once = found.filter("NOT near").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    ranked = once.withColumn("place", F.row_number().over(order))
    return stored(ranked.filter(F.col("place") <= how.places).select("a", "b", "sim"), "lists")


def _near(found: DataFrame) -> DataFrame:
    return found.filter("near").select("a", "b")


def _local_joins(lists: DataFrame, classes: DataFrame, how: Descent) -> DataFrame:
    """Pairs among the neighbours of each vector that improve a list, and new links.

    A vector on very many lists has its admirers dealt into blocks, each with its own
    list; no one is left out.
    """
    worst = lists.groupBy("a").agg(
        F.when(F.count("*") >= how.places, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst")
    )
    share = how.block // 4
    admired = lists.groupBy("b").agg(F.ceil(F.count("*") / share).alias("parts"))
    own = lists.select(F.col("a").alias("w"), F.col("b").alias("node"))
    back = lists.select(F.col("b").alias("w"), F.col("a").alias("node"))
    parts = stored(admired.select(F.col("b").alias("w"), "parts"), "admired")
    itself = lists.select("a").distinct().select(F.col("a").alias("w"), F.col("a").alias("node"))
    wide = (
        own.union(itself)
        .join(parts, "w", "left")
        .select("w", "node", F.explode(F.sequence(F.lit(0), (F.coalesce("parts", F.lit(1)) - 1).cast("int"))).alias("part"))
    )
    split = back.join(parts, "w").select("w", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    members = wide.union(split).distinct()
    known = classes.select("node", "embedding").join(worst.withColumnRenamed("a", "node"), "node")
    # some hundred groups of neighbours go to a task at once
    batches = max(1, -(-lists.count() // (how.places * how.block)))
    full = members.join(known, "node").withColumn("batch", F.pmod(F.xxhash64("w", "part"), F.lit(batches)))

    def refine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["w", "part"])
        ids, worst_of = rows["node"].to_numpy(np.int64), rows["worst"].to_numpy(float)
        w, part = rows["w"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
        vectors = np.stack(rows["embedding"].to_list()) if len({len(x) for x in rows["embedding"]}) == 1 else None
        edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (part[1:] != part[:-1]), [True]]))
        out = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = vectors[lo:hi] if vectors is not None else np.stack(rows["embedding"].to_list()[lo:hi])
            sim = _cosines(own)
            np.fill_diagonal(sim, -2)
            i, j = np.nonzero(sim > worst_of[lo:hi, None])
            out.append((ids[lo + i], ids[lo + j], sim[i, j], np.zeros(len(i), bool)))
            member, root = _stars(ids[lo:hi], sim >= how.threshold)
            out.append((member, root, np.ones(len(member)), np.ones(len(member), bool)))
        a, b, sim, near = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"a": a, "b": b, "sim": sim, "near": near}).drop_duplicates(["a", "b", "near"])

    return full.groupBy("batch").applyInPandas(refine, _PAIR)


def _exact_degrees(classes: DataFrame, label: DataFrame, how: Descent) -> DataFrame:
    """(node, component, linked): rows linked directly, counted over the whole connected group.

    Groups larger than a block are compared block by block, one pair of blocks in a task.
    """
    sizes = label.groupBy("component").agg(F.ceil(F.count("*") / how.block).cast("int").alias("parts"))
    grouped = stored(
        label.join(stored(sizes, "group-sizes"), "component")
        .join(classes.select("node", "n", "embedding"), "node")
        .withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")),
        "groups",
    )
    # as the left side a vector meets the blocks from its own on, as the right side those up to it
    left = grouped.select("*", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"))
    right = grouped.filter("part > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("other"))
    pairs = left.select("component", "node", "n", "embedding", F.col("part").alias("i"), F.col("other").alias("j"), F.lit(True).alias("first")).union(
        right.select("component", "node", "n", "embedding", F.col("other").alias("i"), F.col("part").alias("j"), F.lit(False).alias("first"))
    )
    # small groups go to a task together
    batch = F.when(F.col("parts") > 1, F.xxhash64("component", "i", "j")).otherwise(F.pmod(F.xxhash64("component"), F.lit(997)))
    keyed = pairs.join(sizes, "component").withColumn("batch", batch)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        out = [_linked(group, how.threshold) for _, group in rows.groupby(["component", "i", "j"], sort=False)]
        return pd.concat(out)

    counted = keyed.groupBy("batch").applyInPandas(count, "node long, component long, linked long")
    return counted.groupBy("node", "component").agg(F.sum("linked").alias("linked"))


def _linked(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    a = rows[rows["first"]]
    b = a if rows["i"].iloc[0] == rows["j"].iloc[0] else rows[~rows["first"]]
    if not len(a) or not len(b):
        return pd.DataFrame({"node": [], "component": [], "linked": []}).astype("int64")
    near = _cosines(np.stack(a["embedding"].to_list()), np.stack(b["embedding"].to_list())) >= threshold
    if a is b:
        np.fill_diagonal(near, False)
        sides = [(a, near @ a["n"].to_numpy())]
    else:
        sides = [(a, near @ b["n"].to_numpy()), (b, near.T @ a["n"].to_numpy())]
    return pd.concat(
        [pd.DataFrame({"node": x["node"], "component": x["component"], "linked": n.astype(np.int64)}) for x, n in sides]
    )


def _audited_recall(classes: DataFrame, label: DataFrame, how: Descent) -> float:
    """Share of a sample's true links that lie within its connected group.

    The sample has ``audited`` vectors of each kind, the first by a hash of the id; they
    are compared with all vectors of their kind, block by block.
    """
    order = Window.partitionBy("kind").orderBy(F.xxhash64("node"), "node")
    asked = classes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= how.audited)
    placed = classes.select("node", "kind", "embedding").join(label, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    samples = stored(asked.select("node").join(placed, "node"), "audit")
    # a sample has at most ``audited`` vectors of a kind; it meets each block of its kind
    blocks = classes.groupBy("kind").agg(F.ceil(F.count("*") / (16 * how.block)).cast("int").alias("blocks"))
    blocks = stored(blocks, "audit-blocks")
    ask = samples.join(blocks, "kind").select(
        "kind", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "component", "embedding", F.lit(True).alias("asks")
    )
    met = placed.join(blocks, "kind").select(
        "kind", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node", "component", "embedding", F.lit(False).alias("asks")
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"links": [0], "inside": [0]})
        near = _cosines(np.stack(a["embedding"].to_list()), np.stack(b["embedding"].to_list())) >= how.threshold
        near &= a["node"].to_numpy()[:, None] != b["node"].to_numpy()[None, :]
        same = a["component"].to_numpy()[:, None] == b["component"].to_numpy()[None, :]
        return pd.DataFrame({"links": [int(near.sum())], "inside": [int((near & same).sum())]})

    got = ask.union(met).groupBy("kind", "block").applyInPandas(compare, "links long, inside long")
    total = got.agg(F.sum("links").alias("links"), F.sum("inside").alias("inside")).first()
    return total.inside / total.links if total.links else 1.0
