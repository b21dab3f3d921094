"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

Each text becomes the set of its distinct word shingles. Equal sets form one
class. Band keys of MinHash samples bring classes together; the samples of a
class are also folded into an odd sketch, a parity bitmap, and the number of
bits in the XOR of two sketches tells how many samples differ. Pairs that differ
too much are dropped by that count inside the join; the rest is confirmed on the
full sets.

Large groups do not produce all their pairs. First each class is compared with the
most central member of a bucket, and in later turns with ever more of those that are
connected already; what links is contracted. Then only members outside the largest component of their bucket meet the rest of the
bucket, so every two classes of one bucket are either compared or already connected.
There a finer sketch, made of these members only, rules out most pairs just below the
threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.frames import map_batches, stored, temporary
from trafficlens.llm.minhash import SKETCH_WORDS, MinHasher
from trafficlens.llm.words import mix, shingle_hashes, words

_SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
# members of a bucket that are compared with others in one task
BLOCK_MEMBERS = 1024
# members outside the main component choose their buckets in so many orders, so that no one bucket has them all
HUB_GROUPS = 4
# finer sketches in a batch
_FINE_AT_ONCE = 1024
_SET = "doc_id long, set_a long, members array<long>, sketch array<long>"
_FINE = "node long, fine array<long>"


@dataclass(frozen=True)
class NearDuplicates:
    """similarity in percent; bands x rows: 32 x 5 misses a pair at 80 % three times in a million.

    The odd sketch holds sketch_samples more, a finer one of fine_bits fine_samples: it is
    made of the members that meet all of a bucket. hub_turns: how often members outside the
    main component of a bucket try others of it before they meet all, hubs of them at
    first and twice as many every turn.
    """

    shingle_words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    sketch_samples: int = 1000
    fine_samples: int = 4000
    fine_bits: int = 8192
    hub_turns: int = 4
    hubs: int = 8

    def hasher(self) -> MinHasher:
        return MinHasher(self.bands, self.rows)

    def sketcher(self) -> MinHasher:
        """Only classes that share a bucket are sketched, so it has samples of its own."""
        return MinHasher(self.sketch_samples, 1, seed=11)

    def finer(self) -> MinHasher:
        """For members of large families: it tells 0.76 from 0.8, the other 0.72."""
        return MinHasher(self.fine_samples, 1, seed=13, sketch_bits=self.fine_bits)


def near_duplicates(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are folded from A-Z to a-z. A text with fewer words than a shingle is one
    shingle; a null text or one without words has an empty set and links with
    nothing. component_id is the smallest doc_id reachable by links, kept says
    whether the row's id is it. Rows with one doc_id count as one document. A row
    without doc_id links with nothing: its component_id is null and it is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    ids = docs.select(F.col("doc_id").cast("long"), "text")
    rows = stored(map_batches(ids, _signer(how), _SIGNATURE), "signatures")
    with temporary(docs):
        same = ["n_shingles", "set_a", "set_b"]
        filled = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        classes = stored(
            filled.groupBy(*same).agg(
                F.min("doc_id").alias("node"), F.first("bands").alias("bands")
            ),
            "classes",
        )
        label = components(linked_classes(classes, lambda profile: _sets(ids, profile, how), how))
        of_class = stored(
            classes.select(*same, "node")
            .join(label, "node", "left")
            .select(*same, F.coalesce("component", "node").alias("component_id")),
            "class-components",
            keep=True,
        )
    with_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    alone = rows.filter(~with_set).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = rows.filter(with_set).select("doc_id", *same).join(of_class, same)
    return (
        linked.select("doc_id", "n_shingles", "component_id")
        .union(alone)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def linked_classes(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], how: NearDuplicates) -> DataFrame:
    """Enough confirmed links (a, b) to connect all that links connect.

    classes: (node, n_shingles, set_a, bands). sets_of gives (node, members, sketch) for
    some of these rows.
    """
    shown = classes.select("node", F.explode("bands").alias("bucket"))
    shared = stored(shown.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    members = stored(shown.join(shared, "bucket"), "members")
    # the hub of a bucket is the member that shares most buckets with others: what copies were made of
    central = members.groupBy("node").agg(F.sum("size").alias("beside"))
    hubs = members.join(central, "node").groupBy("bucket").agg(
        F.max(F.struct("beside", (-F.col("node")).alias("hub"))).alias("most")
    )
    hubs = stored(hubs.select("bucket", (-F.col("most.hub")).alias("hub")), "hubs")
    wanted = stored(
        classes.join(central.select("node"), "node").select("node", "n_shingles", "set_a", "bands"), "wanted"
    )
    sets = stored(sets_of(wanted), "sets")
    profile = stored(wanted.join(sets.select("node", "sketch"), "node"), "profiles")

    # one hub for each member: the one it shares most buckets with
    met = members.join(hubs, "bucket").filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("best"))
    to_hub = _beside(best.select(F.col("node").alias("a"), (-F.col("best.hub")).alias("b")), profile, how)
    links = stored(_confirmed(to_hub.select("a", "b"), sets, how), "links")
    placed, open_buckets = _placed(members, links)
    for turn in range(how.hub_turns):
        if open_buckets.isEmpty():
            return links
        links = stored(links.union(_to_other_hubs(placed, open_buckets, profile, sets, how, turn)), "links")
        placed, open_buckets = _placed(members, links)
    waiting = stored(placed.join(open_buckets, "bucket"), "waiting")
    own_sets = sets.join(waiting.select("node").distinct(), "node", "left_semi").select("node", "members")
    fine = stored(map_batches(own_sets, _fine_maker(how), _FINE), "fine-sketches")
    left = stored(waiting.join(profile.drop("set_a"), "node").join(fine, "node"), "open-members")
    # members of a bucket lie in blocks, and one outside its main component is sent to each of them
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")
    a = left.filter("component <> main").select(
        "bucket", every, F.col("component").alias("c_a"), F.col("bands").alias("bands_a"), F.col("fine").alias("fine_a"), *_side("a")
    )
    b = left.select("bucket", own, F.col("component").alias("c_b"), F.col("bands").alias("bands_b"), F.col("fine").alias("fine_b"), *_side("b"))
    # a pair that shares several buckets comes from the first of them
    first_shared = F.array_intersect("bands_a", "bands_b")[0] == a["bucket"]
    same = (a["bucket"] == b["bucket"]) & (a["block"] == b["block"])
    across = a.join(
        b, same & (F.col("c_a") != F.col("c_b")) & _may_link(how) & first_shared & _still_may_link(how)
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.union(_confirmed(stored(across.distinct(), "across"), sets, how))


def _placed(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, component) by the links so far, and of the buckets with several
    components (bucket, main, main_size, members): the largest of them and the sizes."""
    label = components(links)
    placed = stored(
        members.join(label, "node", "left").select(
            "bucket", "node", F.coalesce("component", "node").alias("component")
        ),
        "placed",
    )
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_buckets = (
        sizes.groupBy("bucket")
        .agg(
            F.count("*").alias("components"),
            F.max(F.struct("n", "component")).alias("main"),
            F.sum("n").alias("members"),
        )
        .filter("components > 1")
        .select("bucket", F.col("main.component").alias("main"), F.col("main.n").alias("main_size"), "members")
    )
    return placed, stored(open_buckets, "open-buckets")


def _to_other_hubs(placed, open_buckets, profile, sets, how: NearDuplicates, turn: int) -> DataFrame:
    """Links of members outside the main component of a bucket to some inside.

    In one of its buckets each meets about ``hubs`` members of the main component, twice as
    many every turn; the one whose sketch is nearest is confirmed. So a member that links
    with one in p of the main component is inside after about p meetings.
    """
    inside = placed.join(open_buckets, "bucket")
    hubs = how.hubs << turn
    drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("main_size")) < hubs
    hub = inside.filter(F.col("component") == F.col("main")).filter(drawn).select("bucket", F.col("node").alias("b"))
    outside = _one_bucket(inside.filter(F.col("component") != F.col("main")), turn)
    # sketches are compared where the bucket's members meet, so pairs that they rule out are never rows
    # drawn first: else all members of these buckets would pass the join
    hub = stored(hub, "drawn").join(outside.select("bucket").distinct(), "bucket", "left_semi")
    a = outside.withColumnRenamed("node", "a").join(profile.select(*_side("a")), "a")
    b = hub.join(profile.select(*_side("b")), "b")
    near = stored(a.join(b, "bucket").filter(_may_link(how)).select("a", "b", _odd_bits().alias("odd")), "met")
    best = near.groupBy("a").agg(F.min(F.struct("odd", "b"))["b"].alias("b"))
    return _confirmed(best, sets, how)


def _one_bucket(members: DataFrame, turn: int) -> DataFrame:
    """One of the buckets of each node, another one every turn.

    Nodes that share buckets take the same ones, so few buckets have to send hubs.
    """
    group = F.pmod(F.xxhash64("node"), F.lit(HUB_GROUPS))
    order = F.struct(F.xxhash64("bucket", group, F.lit(turn)), "bucket")
    return members.groupBy("node").agg(F.min(order)["bucket"].alias("bucket"))


def _beside(pairs: DataFrame, profile: DataFrame, how: NearDuplicates) -> DataFrame:
    """(a, b, odd) of the pairs that sizes and sketches do not rule out."""

    a, b = (profile.select(*_side(x)) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").filter(_may_link(how))
    return both.select("a", "b", _odd_bits().alias("odd"))


def _side(name: str) -> list:
    """Node, size and the words of the sketch of one side of a pair; plain columns, so that
    comparing sketches is compiled code."""
    words = [F.col("sketch")[k].alias(f"{name}{k}") for k in range(SKETCH_WORDS)]
    return [F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), *words]


def _odd_bits():
    """Bits set in the XOR of the two sketches."""
    words = [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(SKETCH_WORDS)]
    return reduce(add, words)


def _may_link(how: NearDuplicates):
    """Sizes allow the similarity, and the odd sketches do not rule it out."""
    sizes = (F.col("n_a") * 100 >= F.col("n_b") * how.percent) & (F.col("n_b") * 100 >= F.col("n_a") * how.percent)
    return sizes & (_odd_bits() <= how.sketcher().most_odd_bits(how.percent / 100))


def _still_may_link(how: NearDuplicates):
    """The finer sketches do not rule the similarity out either."""
    odd = F.zip_with("fine_a", "fine_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(odd, F.lit(0), lambda total, n: total + n) <= how.finer().most_odd_bits(how.percent / 100)


def _confirmed(pairs: DataFrame, sets: DataFrame, how: NearDuplicates) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("m_a"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("m_b"))
    common = F.size(F.array_intersect("m_a", "m_b"))
    union = F.size("m_a") + F.size("m_b") - common
    return pairs.join(a, "a").join(b, "b").filter(common * 100 >= union * how.percent).select("a", "b")


def _sets(ids: DataFrame, profile: DataFrame, how: NearDuplicates) -> DataFrame:
    """(node, members): the full set of each class in a shared bucket, made again from its text."""
    wanted = profile.select(F.col("node").alias("doc_id"))
    # merged at every size: the wanted ids grow with the documents
    made = map_batches(ids.join(wanted.hint("merge"), "doc_id", "left_semi"), _set_maker(how), _SET)
    own = profile.select(F.col("node").alias("doc_id"), "set_a")
    whole = made.join(own, ["doc_id", "set_a"])
    return whole.select(F.col("doc_id").alias("node"), "members", "sketch").dropDuplicates(["node"])


def _shingle_sets(texts: pa.Array, size: int):
    """The sorted distinct shingle hashes of each text, in order."""
    for part in words(texts, lower=True):
        for i in range(len(part)):
            own = part.hashes[part.offsets[i] : part.offsets[i + 1]]
            yield np.unique(shingle_hashes(own, size))


def _fingerprint(members: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in two halves."""
    a = mix(members).sum(dtype=np.uint64)
    b = mix(members ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signer(how: NearDuplicates):
    def sign(batches):
        hasher = how.hasher()
        for batch in batches:
            out = []
            for members in _shingle_sets(batch.column("text"), how.shingle_words):
                if len(members):
                    bands = hasher.band_keys(hasher.samples(members))
                    out.append((len(members), *_fingerprint(members), bands))
                else:
                    out.append((0, 0, 0, []))
            n, a, b, bands = zip(*out, strict=True) if out else ([],) * 4
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(n, pa.int64()),
                    "set_a": pa.array(a, pa.int64()),
                    "set_b": pa.array(b, pa.int64()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )

    return sign


def _set_maker(how: NearDuplicates):
    def make(batches):
        sketcher = how.sketcher()
        for batch in batches:
            ids, at, rows, size = batch.column("doc_id"), 0, [], 0
            for members in _shingle_sets(batch.column("text"), how.shingle_words):
                rows.append(members)
                at, size = at + 1, size + len(members)
                if size > 1 << 20 or at == len(ids):
                    yield pa.record_batch(
                        {
                            "doc_id": ids.slice(at - len(rows), len(rows)),
                            "set_a": pa.array([_fingerprint(x)[0] if len(x) else 0 for x in rows], pa.int64()),
                            "members": pa.array([x.view(np.int64) for x in rows], pa.list_(pa.int64())),
                            "sketch": pa.array([sketcher.sketch_of(x) for x in rows], pa.list_(pa.int64())),
                        }
                    )
                    rows, size = [], 0

    return make


def _fine_maker(how: NearDuplicates):
    def make(batches):
        finer = how.finer()
        for batch in batches:
            members = batch.column("members")
            for i in range(0, len(members), _FINE_AT_ONCE):
                some = members.slice(i, _FINE_AT_ONCE)
                made = [finer.sketch_of(x.values.to_numpy().view(np.uint64)) for x in some]
                yield pa.record_batch(
                    {"node": batch.column("node").slice(i, len(some)), "fine": pa.array(made, pa.list_(pa.int64()))}
                )

    return make


def keep_one(docs: DataFrame, how: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The documents without those that ``near_duplicates`` does not keep; all columns."""
    dropped = near_duplicates(docs, how).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
