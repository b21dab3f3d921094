"""Merkle manifests with a proof for every row, by pointer jumping.

Rows are leaves. Those of one group form a binary tree in the order of a key, and the
roots of the groups form another in the order of the groups. Nodes hold a segment: the
siblings from the node up to some ancestor. At first the ancestor is the parent. Every
round joins nodes with the nodes that are their ancestors and appends the segments, so
the distance doubles, until every leaf has reached the root. Only nodes at multiples of
the next distance are still asked for, so one side of the joins shrinks to its square
root each round while the leaves stay.

A digest travels as 32 bytes and is hashed as lower-case hexadecimal text.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.frames import map_batches, stored, temporary, with_fields
from trafficlens.shipping import ship_package

# a task makes the lowest levels of the tree over this many neighbouring leaves at a time
BLOCK_LEVELS = 12
DIGEST = 32
# the top tree is repeated this often, so that leaves of one group meet it in many tasks
SALTS = 16
_NODE = "tree long, level int, node long, digest binary, sibling binary, top boolean, root boolean"


@dataclass(frozen=True)
class Manifest:
    """fields: what a leaf digests, in this order; group and key: trees and order of leaves."""

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    key: str = "doc_id"


def leaf_digest(*values: Column) -> Column:
    """sha256, as 32 bytes, of the values: ``-`` for null, else UTF-8 length, ``:``, value."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _joined(digests: list[bytes]) -> bytes:
    return sha256(b"".join(digests).hex().encode()).digest()


def _ranked(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame, Column]:
    """``rows`` (with ``tree``) numbered by tree in the given order, nulls first.

    Rows are range-partitioned by tree and order, so one large tree lies in many tasks.
    Gives them with ``at``, the table that has the offset of each tree in each task, one
    row for both, and the condition that joins the two.
    """
    keys = [F.col("tree").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    numbered = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()),
        name,
    ).withColumn("task", F.shiftright("at", 33))
    parts = numbered.groupBy("tree", "task").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("tree").alias("of"),
        F.col("task").alias("in_task"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    same = F.col("tree").eqNullSafe(F.col("of")) & (F.col("task") == F.col("in_task"))
    return numbered, stored(parts, f"{name}-offsets"), same


def _block(base: int, payload: list[str], levels: int):
    """The nodes of a block above ``base``, up to its top or the root, with their siblings."""

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        size, first = table.column("size")[0].as_py(), table.column("node")[0].as_py()
        digests, out = table.column("digest").to_pylist(), []
        for up in range(levels + 1):
            top = up == levels or size == 1
            for i, digest in enumerate(digests):
                # the last node of a level may stand alone
                sibling = digests[i ^ 1] if not top and (i ^ 1) < len(digests) else None
                out.append((base + up, first + i, digest, sibling, top, size == 1))
            if top:
                break
            digests = [_joined(digests[i : i + 2]) for i in range(0, len(digests), 2)]
            first, size = first >> 1, -(-size // 2)
        columns = dict(zip(("level", "node", "digest", "sibling", "top", "root"), zip(*out, strict=True), strict=True))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
        made = {n: pa.array(c, k) for (n, c), k in zip(columns.items(), kinds, strict=True)}
        made = {"tree": pa.array([key[0].as_py()] * len(out), pa.int64()), **made}
        for name in payload:  # belongs to the leaves, which come first
            own = table.column(name).combine_chunks()
            made[name] = pa.concat_arrays([own, pa.nulls(len(out) - len(own), own.type)])
        return pa.table(made)

    return build


def _nodes(leaves: DataFrame, payload: list[str], name: str) -> tuple[DataFrame, DataFrame, int]:
    """All nodes of trees over leaves (tree, node, size, digest and payload), block by block.

    Gives the leaves with their siblings, the nodes above them, and the greatest height.
    """
    ship_package(leaves.sparkSession)
    largest = leaves.agg(F.max("size")).first()[0] or 0
    height, base, made = max(largest - 1, 0).bit_length(), 0, []
    fields = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    sizes = stored(leaves.select("tree", F.col("size").alias("whole")).distinct(), f"{name}-sizes")
    while True:
        carried = payload if base == 0 else []
        schema = _NODE + "".join(f", {c} {fields[c]}" for c in carried)
        blocks = leaves.select("tree", "node", "size", "digest", *carried).groupBy(
            "tree", F.shiftright("node", BLOCK_LEVELS).alias("block")
        )
        made.append(stored(blocks.applyInArrow(_block(base, carried, BLOCK_LEVELS), schema), f"{name}-nodes", keep=base == 0))
        base += BLOCK_LEVELS
        if base > height:
            break
        ups = made[-1].filter("top AND NOT root").join(sizes, "tree")
        leaves = ups.select("tree", "node", F.expr(f"shiftright(whole - 1, {base}) + 1").alias("size"), "digest")
    inner = made[0].filter("level > 0 AND (root OR NOT top)").drop(*payload)
    for more in made[1:]:
        inner = inner.unionByName(more.filter("root OR NOT top"))
    return made[0].filter("level = 0"), inner, height


def _paths(leaves: DataFrame, inner: DataFrame, height: int, name: str) -> DataFrame:
    """Leaves plus ``segment``, their siblings up to the root, by doubling distances."""
    segment = F.coalesce("sibling", F.lit(b""))
    now = stored(inner.select("tree", "level", "node", segment.alias("segment")), f"{name}-segments", keep=True)
    leaves = leaves.withColumn("segment", segment)
    distance = 1
    while distance < height:
        ends = now.filter(F.col("level") % (2 * distance) == distance).select(
            F.col("tree").alias("of"), F.col("level").alias("there"), F.col("node").alias("ancestor"),
            F.col("segment").alias("further"),
        )
        longer = F.concat("segment", F.coalesce("further", F.lit(b"")))
        same = (F.col("tree") == F.col("of")) & (F.shiftright("node", distance) == F.col("ancestor"))
        leaves = (
            leaves.join(ends.filter(F.col("there") == distance), same, "left")
            .withColumn("segment", longer)
            .drop("of", "there", "ancestor", "further")
        )
        near = now.filter(F.col("level") % (2 * distance) == 0)
        near = near.join(ends, same & (F.col("level") + distance == F.col("there")), "left")
        now = stored(near.select("tree", "level", "node", longer.alias("segment")), f"{name}-segments", keep=True)
        distance *= 2
    return leaves


def manifest(docs: DataFrame, how: Manifest = Manifest(), claims: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: where it stands in the tree and how to prove it.

    Columns: the key; ``leaf``; ``subroot`` and ``root`` (digests of the group's tree and of
    the whole); ``tree`` and ``trees`` (number of the group, number of groups), ``node`` and
    ``size`` (place in the group, its rows); ``segment`` (siblings from the leaf to the root,
    32 bytes each, so one after another they are the proof); and the claims, digests that
    are computed from ``docs`` and only carried along, to be held against the tree.

    Nulls come first among keys and groups and are digested as ``-``. Rows that share a
    key are ordered by their digest; equal rows have equal leaves and a proof each. An
    empty text is a value of length 0. Other columns are not read, so their names do not
    matter. An empty table gives an empty result. Tables below ``spark.checkpoint.dir``
    that the result reads stay there.
    """
    claims = claims or {}
    payload = ["key", *(f"claim{i}" for i in range(len(claims)))]
    with temporary(docs):
        rows = docs.select(
            F.col(how.group).cast("string").alias("tree"),
            F.col(how.key).alias("key"),
            leaf_digest(*(F.col(c) for c in how.fields)).alias("digest"),
            *(c.alias(f"claim{i}") for i, c in enumerate(claims.values())),
        )
        numbered, offsets, same = _ranked(rows, ["key", "digest"], "leaves")
        groups = offsets.select(F.lit(0).cast("long").alias("tree"), F.col("of").alias("group")).distinct()
        listed, starts, own = _ranked(groups, ["group"], "groups")
        listed = stored(
            listed.join(starts, own).select("group", (F.col("at") + F.col("shift")).cast("long").alias("number"), F.col("size").alias("trees")),
            "group-numbers",
        )
        offsets = stored(
            offsets.join(listed, F.col("of").eqNullSafe(F.col("group"))).drop("group"), "offsets"
        )
        placed = stored(
            numbered.join(offsets, same).select(
                F.col("number").alias("tree"),
                (F.col("at") + F.col("shift")).cast("long").alias("node"),
                F.col("size").cast("long").alias("size"),
                "digest",
                *payload,
            ),
            "placed",
        )
        leaves, inner, height = _nodes(placed, payload, "tree")
        sizes = placed.groupBy("tree").agg(F.first("size").alias("rows"))
        roots = leaves.filter("root").select("tree", "digest").unionByName(inner.filter("root").select("tree", "digest"))
        subroots = stored(
            roots.join(sizes, "tree")
            .join(listed, F.col("tree") == F.col("number"))
            .select(
                F.lit(0).cast("long").alias("tree"),
                F.col("number").alias("node"),
                F.col("trees").cast("long").alias("size"),
                "digest",
                "rows",
            ),
            "subroots",
        )
        tops, above, levels = _nodes(subroots, ["rows"], "top")
        whole = tops.filter("root").select("tree", "digest").union(above.filter("root").select("tree", "digest"))
        paths = _paths(tops, above, levels, "top").select(
            "tree", F.col("node").alias("number"), "rows", F.col("digest").alias("subroot"), F.col("segment").alias("further")
        )
        # one row at most, so it may go to every task
        paths = paths.join(F.broadcast(whole.select("tree", F.col("digest").alias("root"))), "tree").drop("tree")
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        paths = stored(paths.join(listed.select("number", "trees"), "number").select("*", salt), "top-paths", keep=True)
        leaves = _paths(leaves, inner, height, "tree").drop("root")
        met = leaves.join(
            paths, (F.col("tree") == F.col("number")) & (F.col("node") % SALTS == F.col("salt"))
        )
        return met.select(
            F.col("key").alias(how.key),
            F.col("digest").alias("leaf"),
            "subroot",
            "root",
            "tree",
            F.col("trees").cast("long").alias("trees"),
            "node",
            F.col("rows").alias("size"),
            F.concat("segment", "further").alias("segment"),
            *(F.col(f"claim{i}").alias(c) for i, c in enumerate(claims)),
        )


def _fold(digest: str, node: int, size: int, siblings: list[str]) -> str:
    """The root above a node, from its siblings level by level; they are used up."""
    while size > 1:
        if node ^ 1 < size:
            other = siblings.pop()
            both = other + digest if node & 1 else digest + other
        else:
            both = digest
        digest = sha256(both.encode()).hexdigest()
        node, size = node >> 1, -(-size // 2)
    return digest


def _folder(names: list[str], claims: list[str]):
    def fold(batches):
        for batch in batches:
            columns = {n: batch.column(n) for n in names}
            places = list(zip(*(columns[c].to_pylist() for c in ("node", "size", "tree", "trees", "segment")), strict=True))
            proofs = [segment.hex() for *_, segment in places]
            columns["proof_sha256"] = pa.array([sha256(p.encode()).hexdigest() for p in proofs], pa.string())
            for claim in claims:
                found = []
                for digest, (node, size, tree, trees, _), proof in zip(
                    columns[claim].to_pylist(), places, proofs, strict=True
                ):
                    siblings = [proof[i : i + 2 * DIGEST] for i in range(0, len(proof), 2 * DIGEST)][::-1]
                    below = _fold(digest.hex(), node, size, siblings)
                    found.append(_fold(below, tree, trees, siblings))
                columns[f"{claim}_root"] = pa.array(found, pa.string())
            yield pa.record_batch(columns)

    return fold


def folded(rows: DataFrame, claims: list[str]) -> DataFrame:
    """Rows of ``manifest`` plus ``proof_sha256`` and for each claim the root it leads to.

    ``<claim>_root`` is lower-case hexadecimal. A claim holds if it equals the root; the
    leaf itself is such a claim.
    """
    kinds = {"proof_sha256": "string", **{f"{c}_root": "string" for c in claims}}
    return map_batches(rows, _folder(rows.columns, claims), with_fields(rows, **kinds))
