"""Mixing sources to target weights by thresholds on a hash.

Every document gets a hash of its id and text. A source that takes q times its
size takes each document floor(q) times, and once more those whose hash lies
below a threshold at which their sizes add up to the rest. The threshold is found
without sorting: a histogram of sizes by the leading bits of the hash tells which
bucket the budget ends in, and only the documents of that bucket are counted again
by their next bits. Thresholds of growing budgets are nested, so a larger budget
keeps all that a smaller one takes. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.frames import stored, temporary

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Source weights repeat in order of source; the mix has ``share_percent`` of all words.

    No source gives more than ``most_copies`` times its size. A hash has
    ``levels`` times ``bits`` bits, 60 at most and a multiple of four: leading digits of md5.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share_percent: int = 150
    most_copies: int = 2
    bits: int = 10
    levels: int = 6


def mixed(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, source) with size, source_size, target, copies, taken.

    size counts words (null text: 0). Sources stand in code point order, null last.
    target is the source's share by weight, at most most_copies times its size; what
    that cuts off goes to the others by weight. taken is copies x size. A source
    without words has target 0. Rows that agree in id and text have one hash and are
    taken alike; otherwise a source's taken words miss its target by less than one
    document. Columns of the input with these names are replaced. An empty table
    gives an empty result.
    """
    kept = [c for c in docs.columns if c not in {"size", "source_size", "target", "copies", "taken"}]
    sized = docs.select(*kept, F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    content = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    digits = how.bits * how.levels // 4
    keyed = sized.withColumn("_hash", F.conv(F.substring(F.md5(content), 1, digits), 16, 10).cast("long"))
    with temporary(docs):
        light = stored(keyed.select(_source(), "size", "_hash"), "sizes")
        plan = stored(_thresholds(light, _targets(light, how), how), "mix", keep=True)
    source, given = _source().alias("_source"), F.col("size")
    copies = (F.col("whole") + F.when(F.col("_hash") <= F.col("threshold"), 1).otherwise(0)).cast("int")
    return (
        keyed.withColumn("_source", source)
        .join(plan, "_source")
        .select(*kept, "size", "source_size", "target", copies.alias("copies"), (copies * given).alias("taken"))
    )


def _source():
    """A key that is never null and sorts by code point, with null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("_source")


def _targets(light: DataFrame, how: Mix) -> DataFrame:
    """(_source, source_size, target): one row for each source.

    With level L a source gets min(weight x L, cap). Sources in order of
    cap / weight reach their cap one after another; the level is the budget left
    after the capped ones, divided by the weights of the others.
    """
    per_source = light.groupBy("_source").agg(F.sum("size").alias("source_size"))
    ordered = per_source.withColumn("place", F.row_number().over(Window.orderBy("_source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), (F.col("place") - 1) % len(how.weights) + 1)
    shares = ordered.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * how.most_copies)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "_source")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        shares.withColumn("budget", F.sum("source_size").over(everything) * F.lit(how.share_percent) / 100)
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", (F.col("budget") - F.col("capped")) / F.col("open") * F.col("weight"))
    )
    full = F.max((F.col("share") < F.col("cap")).cast("int")).over(by_fill.rowsBetween(Window.unboundedPreceding, 0)) == 0
    levelled = filled.withColumn("full", full)
    # the level stays the same from the first source that is not full
    level = F.min(F.when(~F.col("full"), F.struct("capped", (F.col("share") / F.col("weight")).alias("level")))).over(everything)
    return levelled.select(
        "_source",
        "source_size",
        F.when(F.col("full"), F.col("cap")).otherwise(level["level"] * F.col("weight")).alias("target"),
    )


def _thresholds(light: DataFrame, targets: DataFrame, how: Mix) -> DataFrame:
    """targets with whole (copies of every document) and threshold (hashes up to it get one more)."""
    ratio = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(ratio + 1e-12)).otherwise(0).cast("long")
    budgets = stored(
        targets.withColumn("whole", whole)
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")),
        "budgets",
    )
    keep = budgets.columns
    for level in range(1, how.levels + 1):
        rest = how.bits * (how.levels - level)
        # only documents in the bucket where the budget of their source ends
        inside = light.join(budgets.select("_source", "prefix"), "_source").filter(
            F.shiftrightunsigned("_hash", rest + how.bits) == F.col("prefix")
        )
        histogram = inside.groupBy("_source", F.shiftrightunsigned("_hash", rest).alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        up_to = F.sum("words").over(Window.partitionBy("_source").orderBy("bucket"))
        # the boundary is the first bucket that does not fit as a whole
        fits = F.col("total") <= F.col("left")
        sums = histogram.withColumn("total", up_to).join(budgets.select("_source", "left"), "_source")
        found = sums.groupBy("_source").agg(
            F.min(F.when(~fits, F.col("bucket"))).alias("boundary"), F.max(F.when(fits, F.col("total"))).alias("used")
        )
        last_bucket = F.shiftleft("prefix", how.bits) + (2**how.bits - 1)
        budgets = stored(
            budgets.join(found, "_source", "left").select(
                *[c for c in keep if c not in ("prefix", "left")],
                F.coalesce("boundary", last_bucket).alias("prefix"),
                (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
            ),
            "budgets",
        )
    # hashes below the boundary are taken, and those on it if that comes nearer to the target
    on_it = light.join(budgets.select("_source", "prefix"), "_source").filter("_hash = prefix")
    tie = on_it.groupBy("_source").agg(F.sum("size").alias("words"))
    take_tie = F.coalesce(F.col("words") <= 2 * F.col("left"), F.lit(True))
    return budgets.join(tie, "_source", "left").select(
        "_source", "source_size", "target", "whole", (F.col("prefix") - F.when(take_tie, 0).otherwise(1)).alias("threshold")
    )


def apply_mix(docs: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The documents of the mix, each as often as it is taken; the columns of ``docs``."""
    plan = mixed(docs.select("*", F.col("text").alias("_text")), how)
    return plan.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)
