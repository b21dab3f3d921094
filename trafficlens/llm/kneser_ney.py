"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over characters. Every character is a symbol, a text's edges are one too,
and characters that trusted text lacks have the share of one more. Counts of
four-symbol runs are summed over all trusted text and stay in tables, which grow with
it: no part of them is broadcast or collected. Documents are dealt into shards of
bounded size where they are read and written once, in buckets of shards. The distinct
runs of all shards are joined with the counts of runs, contexts and shorter ends; the
log probabilities of a shard's runs then travel to its texts, which stay where they
are. Thresholds are quantiles of trusted text by language.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.chars import code_points
from trafficlens.llm.frames import map_batches, stored, temporary, temporary_path, with_fields
from trafficlens.shipping import ship_package

ORDER = 4
# unknown language of a row
NO_LANG = ""
# a run is a context of three code points of 21 bits and the code point behind it
BITS = 21
EDGE = 0x110000
# code points of a shard, and of the texts whose runs are taken at once; bytes of a bucket
SHARD_CHARS = 1 << 22
CHUNK_CHARS = 1 << 18
BUCKET_BYTES = 1 << 24
# runs that a task holds before it sums equal ones
HELD_RUNS = 1 << 20
LEAST = 5e-324
# names of columns on the way, which no table of documents is expected to have
_SHARD, _NATS, _CHARS = "__shard", "__nats", "__chars"


@dataclass(frozen=True)
class PerplexityLimit:
    """A document is rejected if its log perplexity lies further above the trusted median
    of its language than ``reach`` times the distance from the median to the
    ``quantile`` of trusted text. A text of few characters is drawn towards that median as if
    ``prior_chars`` characters of median text came before it.
    """

    quantile: float = 0.95
    reach: float = 3.5
    prior_chars: int = 100


def _trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents whose labels (doc_id, quality) all say 1."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    return good.filter("_q = 1").select(F.col("doc_id").cast("long").alias("_trusted_id"))


def _only_trusted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(_trusted_ids(labels), F.col("doc_id").cast("long") == F.col("_trusted_id"), "left_semi")


def _discount(of_counts: dict[int, int]):
    """What a run's count loses, from the numbers of runs that occur once to four times."""
    n1, n2, n3, n4 = (of_counts.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    steps = [max(0.0, k - (k + 1) * y * b / a) if a else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return F.when(F.col("n") == 1, steps[0]).when(F.col("n") == 2, steps[1]).otherwise(steps[2])



def _sharded(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the number of a shard.

    Rows that are read together share a shard until it has ``SHARD_CHARS``.
    """

    def number(batches):
        row = TaskContext.get().partitionId() << 36
        shard, size = row, 0
        for batch in batches:
            shards = []
            for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
                if size and size + n > SHARD_CHARS:
                    shard, size = row + i, 0
                size += n
                shards.append(shard)
            row += batch.num_rows
            yield pa.record_batch([*batch.columns, pa.array(shards, pa.int64())], names=[*batch.schema.names, _SHARD])

    return map_batches(docs, number, with_fields(docs, **{_SHARD: "long"}))


def _in_buckets(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` in shards, written once in buckets of whole shards, and the name of that table.

    Every task has shards of its own, so writing needs no shuffle, and a task that reads a
    bucket has all rows of its shards.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    name = f"shards_{uuid.uuid4().hex}"
    table = _sharded(docs).write.bucketBy(max(1, -(-size // BUCKET_BYTES)), _SHARD)
    table.option("path", temporary_path(docs, "shards")).option("compression", "zstd").saveAsTable(name)
    return docs.sparkSession.table(name), name


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, last, text) of the runs of texts, about ``CHUNK_CHARS`` at a time.

    A long text is cut; the part behind a cut sees the three symbols before it.
    """
    edge = np.full(ORDER - 1, EDGE, np.int64)
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), CHUNK_CHARS):
            codes = code_points(text[max(0, at - ORDER + 1) : at + CHUNK_CHARS]).astype(np.int64)
            codes = np.concatenate([edge, codes] if at == 0 else [codes])
            if at + CHUNK_CHARS >= len(text):
                codes = np.append(codes, EDGE)
            parts.append(codes)
            owners.append(i)
            size += len(codes)
            if size > CHUNK_CHARS:
                yield _runs(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield _runs(parts, owners)


def _runs(parts: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.concatenate(parts)
    size = np.array([len(p) - ORDER + 1 for p in parts])
    # the runs of a part end behind its first three symbols
    at = np.arange(size.sum()) + np.repeat((ORDER - 1) * np.arange(1, len(parts) + 1), size)
    context = x[at - 3] << 2 * BITS | x[at - 2] << BITS | x[at - 1]
    return context, x[at], np.repeat(owners, size)


def _numbered(context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, last, n) of distinct runs."""
    order = np.lexsort((last, context)) if len(np.unique(last)) >> 10 else None
    if order is None:
        # few symbols: contexts and lasts are numbered, and one key is sorted
        contexts, of_context = np.unique(context, return_inverse=True)
        lasts, of_last = np.unique(last, return_inverse=True)
        key, n = np.unique(of_context * len(lasts) + of_last, return_counts=True)
        return contexts[key // len(lasts)], lasts[key % len(lasts)], n
    context, last = context[order], last[order]
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (last[1:] != last[:-1])]))
    return context[new], last[new], np.diff(np.append(new, len(context)))


def _totals(chunks, counted: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context, last, n) of distinct runs of chunks, in at most a few parts; n is 0 unless counted."""
    parts, size = [], 0
    for context, last, _ in chunks:
        context, last, n = _numbered(context, last)
        parts.append((context, last, n if counted else np.zeros_like(n)))
        size += len(n)
        if size > HELD_RUNS:
            parts = [_summed(parts)]
            # what is held has to double before it is summed again
            size = 0
    return parts


def _summed(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context, last, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((last, context))
    context, last = context[order], last[order]
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (last[1:] != last[:-1])]))
    return context[new], last[new], np.add.reduceat(n[order], new)


def _shorter(size: int):
    """The context of a run of ``size`` symbols without its first symbol."""
    return F.col("context").bitwiseAND(F.lit((1 << BITS * (size - 2)) - 1).cast("long")) if size > 1 else F.lit(0)


def _runs_of_shards(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(shard, context, last, n): the distinct runs of a shard's texts, n of them in trusted text.

    Ids of trusted documents travel to the shards, texts stay in their buckets.
    """
    ids = rows.select(F.col(_SHARD).alias("__of"), F.col("doc_id").cast("long").alias("_trusted_id")).distinct()
    ids = ids.join(_trusted_ids(labels), "_trusted_id")

    def take(key: tuple[pa.Scalar, ...], rows: pa.Table, ids: pa.Table) -> pa.Table:
        trusted = pc.is_in(rows.column("doc_id").cast(pa.int64()), ids.column("_trusted_id"))
        parts = []
        for counted in (True, False):
            own = rows.column("text").filter(trusted if counted else pc.invert(trusted))
            parts += _totals(_chunks([x.as_py() for x in own]), counted)
        context, last, n = _summed(parts) if parts else (np.zeros(0, np.int64),) * 3
        shard = np.full(len(n), key[0].as_py() if len(n) else 0, np.int64)
        return pa.table({_SHARD: shard, "context": context, "last": last, "n": n.astype(np.int64)})

    texts = rows.select(_SHARD, "doc_id", "text")
    return texts.groupBy(_SHARD).cogroup(ids.groupBy("__of")).applyInArrow(
        take, f"{_SHARD} long, context long, last long, n long"
    )


def open_log_probabilities(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(context, last, log_p) of the distinct runs of ``wanted`` under the model of ``counts``."""
    levels, needs = {ORDER: stored(counts, f"runs-{ORDER}")}, {ORDER: stored(wanted.select("context", "last").distinct(), "wanted")}
    for size in range(ORDER - 1, 0, -1):
        context = _shorter(size + 1).alias("context")
        levels[size] = stored(levels[size + 1].groupBy(context, "last").agg(F.count("*").alias("n")), f"runs-{size}")
        needs[size] = needs[size + 1].select(context, "last").distinct()
    # all symbols seen, the edge, and one for the unseen
    symbols = levels[1].filter(F.col("last") != EDGE).count() + 2
    below = None
    for size in range(1, ORDER + 1):
        level, need = levels[size], needs[size]
        of_counts = {r.n: r.many for r in level.filter("n <= 4").groupBy("n").agg(F.count("*").alias("many")).collect()}
        runs = level.withColumn("off", _discount(of_counts))
        contexts = runs.groupBy("context").agg(F.sum("n").alias("all"), F.sum("off").alias("held"))
        need = need.join(runs, ["context", "last"], "left")
        if size == 1:
            whole = contexts.first()
            need = need.withColumns({"all": F.lit(whole["all"] if whole else 1), "held": F.lit(whole["held"] if whole else 1.0)})
            need = need.withColumn("lower", F.lit(1.0 / symbols))
        else:
            need = need.join(contexts, "context", "left").withColumn("shorter", _shorter(size))
            need = need.join(below, ["shorter", "last"])
        p = F.coalesce((F.col("n") - F.col("off")) / F.col("all"), F.lit(0.0)) + F.coalesce(F.col("held") / F.col("all"), F.lit(1.0)) * F.col("lower")
        level_p = stored(need.select("context", "last", p.alias("p")), f"chances-{size}")
        below = level_p.select(F.col("context").alias("shorter"), "last", F.col("p").alias("lower"))
    # a run that the model rules out has the smallest number there is
    return level_p.select("context", "last", F.log(F.greatest("p", F.lit(LEAST))).alias("log_p"))


class _Lookup:
    """Log probabilities by run: all runs asked for are known."""

    def __init__(self, context: np.ndarray, last: np.ndarray, log_p: np.ndarray):
        self._contexts, self._lasts = np.unique(context), np.unique(last)
        key = self._key(context, last)
        order = np.argsort(key)
        self._keys, self._log_p = key[order], log_p[order]

    def _key(self, context, last):
        return np.searchsorted(self._contexts, context) * len(self._lasts) + np.searchsorted(self._lasts, last)

    def log_p(self, context, last):
        return self._log_p[np.searchsorted(self._keys, self._key(context, last))]


def _scorer(kept: list[str]):
    def score(key: tuple[pa.Scalar, ...], rows: pa.Table, known: pa.Table) -> pa.Table:
        lookup = _Lookup(*(known.column(c).to_numpy() for c in ("context", "last", "log_p")))
        nats = np.zeros(rows.num_rows)
        for context, last, text in _chunks([x.as_py() for x in rows.column("text")]):
            nats -= np.bincount(text, lookup.log_p(context, last), rows.num_rows)
        chars = pc.fill_null(pc.utf8_length(rows.column("text")), 0).cast(pa.int64())
        return rows.select(kept).append_column(_NATS, pa.array(nats)).append_column(_CHARS, chars)

    return score


def _scored(docs: DataFrame, labels: DataFrame, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of ``docs`` with minus the log probability and the length of the text."""
    ship_package(docs.sparkSession)
    rows, name = _in_buckets(docs)
    wanted = stored(_runs_of_shards(rows, labels), "shard-runs")
    counts = wanted.filter("n > 0").groupBy("context", "last").agg(F.sum("n").alias("n"))
    known = wanted.drop("n").join(open_log_probabilities(wanted, counts), ["context", "last"]).select(_SHARD, "context", "last", "log_p")
    schema = with_fields(docs.select(kept), **{_NATS: "double", _CHARS: "long"})
    scored = rows.groupBy(_SHARD).cogroup(known.groupBy(_SHARD)).applyInArrow(_scorer(kept), schema)
    scored = stored(scored, "scores", keep=True)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return scored


def judged(
    docs: DataFrame, labels: DataFrame, how: PerplexityLimit = PerplexityLimit(), with_text: bool = True
) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang) with perplexity, threshold and kept.

    Trains on all documents that ``labels`` (doc_id, quality) trusts. perplexity is
    per character, after drawing short texts to the median. A language without trusted
    text, or none, has the quantiles of all trusted text. A null or empty text is
    rejected and has no perplexity. Without any trusted text every document with text
    is kept. Repeated rows are judged each by itself and count each in the model if trusted.
    An empty table gives an empty result. A very long text is read in parts. Input columns
    named perplexity, threshold or kept are replaced; the text itself is left out if it is
    not wanted ``with_text``, which saves a copy.
    """
    docs = docs.drop("perplexity", "threshold", "kept")
    kept = [c for c in docs.columns if with_text or c != "text"]
    with temporary(docs):
        rows = _scored(docs, labels, kept)
        limits = stored(_limits(_only_trusted(rows.filter(F.col(_CHARS) > 0).select("doc_id", "lang", _NATS, _CHARS), labels), how), "limits", keep=True)
    chars, nats, middle, most = (F.col(c) for c in (_CHARS, _NATS, "__middle", "__most"))
    general = limits.filter(F.col("__lang").isNull()).first()
    m_all, t_all = (F.lit(x).cast("double") for x in (general["__middle"], general["__most"]))
    own = limits.filter(F.col("__lang").isNotNull())
    joined = rows.withColumn("__lang", F.coalesce("lang", F.lit(NO_LANG))).join(own, "__lang", "left")
    level = joined.withColumn("__middle", F.coalesce(middle, m_all, F.try_divide(nats, chars))).withColumn(
        "__most", F.coalesce(most, t_all)
    )
    drawn = (nats + middle * how.prior_chars) / (chars + how.prior_chars)
    return level.select(
        *kept,
        F.when(chars > 0, F.exp(drawn)).alias("perplexity"),
        F.exp(most).alias("threshold"),
        ((chars > 0) & F.coalesce(drawn <= most + 1e-9, F.lit(True))).alias("kept"),
    )


def _limits(trusted: DataFrame, how: PerplexityLimit) -> DataFrame:
    """(__lang, __middle, __most): log perplexities; a row with null __lang for all languages together."""
    rates = trusted.select(F.coalesce("lang", F.lit(NO_LANG)).alias("__lang"), (F.col(_NATS) / F.col(_CHARS)).alias("rate"))
    quantiles = F.percentile_approx("rate", [0.5, how.quantile], 1000).alias("q")
    by_lang = rates.groupBy("__lang").agg(quantiles)
    found = by_lang.union(rates.agg(quantiles).select(F.lit(None).cast("string"), "q"))
    middle, far = F.col("q")[0], F.col("q")[1]
    return found.select("__lang", middle.alias("__middle"), (middle + how.reach * (far - middle)).alias("__most"))


def keep_fluent(docs: DataFrame, labels: DataFrame, how: PerplexityLimit = PerplexityLimit()) -> DataFrame:
    """The documents that ``judged`` keeps, with the columns of ``docs``.

    Columns of the input named perplexity, threshold or kept come back as they were.
    """
    own = {c: f"__own_{c}" for c in ("perplexity", "threshold", "kept") if c in docs.columns}
    found = judged(docs.withColumnsRenamed(own), labels, how).filter("kept").drop("perplexity", "threshold", "kept")
    return found.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
