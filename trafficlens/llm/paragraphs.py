"""Duplicate passages inside documents: paragraph MinHash bands, then removal.

A paragraph is a line of enough words. Paragraphs with equal words are one class; band
keys of MinHash samples, tuned for high recall, bring classes together, exact Jaccard
similarity confirms, and of each connected component the first paragraph stays.

A passage pasted into other text is in no two equal paragraphs. So runs of a few words
are compared too. Which runs is decided by their content alone, wherever lines end: of
every ``window`` runs that follow each other the one with the least hash is an anchor, so
two documents that share window + anchor_words - 1 words share an anchor. Anchors that
an earlier document has are marked, and marked anchors without a gap are removed once
they add up to a passage. Shorter repeats, such as a common line or greeting, stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.frames import map_batches, stored, temporary, with_fields
from trafficlens.llm.minhash import MinHasher
from trafficlens.llm.near_dedup import NearDuplicates, linked_classes
from trafficlens.llm.words import Words, mix, shingle_hashes, words

_UNIT = "doc_id long, text_key long, line boolean, lo int, hi int, node long, n_shingles long, bands array<long>"
_CUTS = "__cuts"
_SET = "node long, members array<long>, sketch array<long>"


@dataclass(frozen=True)
class PassageRules:
    """passage_words: repeated words in a row that are a passage; paragraphs of fewer stay too.

    At both ends of a passage up to window - 1 words may lie outside its anchors, so marked
    words count as a passage from passage_words - 2 * (window - 1) on. missed: chance that
    bands of ``rows`` samples miss two paragraphs at ``percent`` similarity.
    """

    shingle_words: int = 5
    percent: int = 80
    rows: int = 3
    missed: float = 0.001
    passage_words: int = 50
    anchor_words: int = 6
    window: int = 8

    def least_marked(self) -> int:
        return max(self.anchor_words, self.passage_words - 2 * (self.window - 1))

    def near(self) -> NearDuplicates:
        bands = ceil(log(self.missed) / log(1 - (self.percent / 100) ** self.rows))
        return NearDuplicates(self.shingle_words, self.percent, bands, self.rows)


def without_repeats(docs: DataFrame, rules: PassageRules = PassageRules()) -> DataFrame:
    """All columns of ``docs`` (doc_id, text), with text cut, and removed_words.

    The copy in the smallest doc_id stays whole. Letters A-Z count as a-z. A null text
    stays null; a row without doc_id is not compared and stays as it is; rows equal in
    doc_id and text are cut alike. An empty table gives an empty result. Cutting leaves the rest of a text as it was, with one
    space or line feed where a passage was. An input column removed_words is replaced.
    """
    docs = docs.drop("removed_words")
    ids = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    with temporary(docs):
        units = stored(map_batches(ids, _splitter(rules), _UNIT), "units")
        own = ["doc_id", "text_key"]
        marked = _marked_anchors(units).groupBy(*own).agg(F.collect_list("lo").alias("anchors"))
        doubled = _doubled_paragraphs(ids, units, rules).groupBy(*own).agg(
            F.collect_list(F.struct("lo", "hi")).alias("paragraphs")
        )
        cuts = marked.join(doubled, own, "full").groupBy("doc_id").agg(
            F.collect_list(F.struct("text_key", "anchors", "paragraphs")).alias(_CUTS)
        )
        cuts = stored(cuts, "cuts", keep=True)
    joined = docs.join(cuts, "doc_id", "left").select(*docs.columns, _CUTS)
    return map_batches(joined, _cutter(rules), with_fields(docs, removed_words="long"))


def keep_first(docs: DataFrame, rules: PassageRules = PassageRules()) -> DataFrame:
    """The columns of ``docs`` with texts cut and n_chars counted anew.

    A document of which nothing is left is dropped; one that had no words stays.
    """
    cut = without_repeats(docs, rules)
    rest = cut.filter((F.col("removed_words") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        chars = F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars"))
        rest = rest.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return rest.select(*docs.columns)


# -- finding ----------------------------------------------------------------------


def _marked_anchors(units: DataFrame) -> DataFrame:
    """(doc_id, text_key, lo) of anchors that an earlier document has."""
    anchors = units.filter("NOT line").select("doc_id", "text_key", "lo", "node")
    first = anchors.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = stored(first.filter("first <> last").select("node", "first"), "shared-anchors")
    # one row for each node, so the hashed side stays small and the anchors need no sort
    met = anchors.join(shared.hint("shuffle_hash"), "node").filter("doc_id <> first")
    return met.select("doc_id", "text_key", "lo")


def _doubled_paragraphs(ids: DataFrame, units: DataFrame, rules: PassageRules) -> DataFrame:
    """(doc_id, text_key, lo, hi) of paragraphs that are not the first of their component."""
    lines = units.filter("line")
    place = F.struct("doc_id", "text_key", "lo", "hi")
    classes = stored(
        lines.groupBy("node").agg(
            F.min(place).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
        ),
        "paragraphs",
    )
    shown = classes.select("node", "n_shingles", F.col("node").alias("set_a"), "bands")

    def sets_of(profile: DataFrame) -> DataFrame:
        wanted = classes.join(profile.select("node"), "node").select("node", "first.*")
        by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("node", "text_key", "lo", "hi")).alias("wanted"))
        texts = ids.join(by_doc.hint("merge"), "doc_id").select("text", "wanted")
        return map_batches(texts, _set_maker(rules), _SET).dropDuplicates(["node"])

    label = components(linked_classes(shown, sets_of, rules.near()))
    grouped = classes.join(label, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    firsts = stored(grouped.groupBy("component").agg(F.min("first").alias("stays")), "firsts")
    stays = stored(grouped.join(firsts, "component").select("node", "stays"), "stays")
    # a paragraph that only its own document repeats is no copy
    other = (F.col("doc_id") != F.col("stays.doc_id")) | (F.col("text_key") != F.col("stays.text_key"))
    return lines.join(stays, "node").filter(other).select("doc_id", "text_key", "lo", "hi")


def _text_key(hashes: np.ndarray) -> int:
    """Of the words of a text in their order."""
    spread = mix(hashes + np.arange(1, len(hashes) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(spread.sum(dtype=np.uint64).view(np.int64))


def _run_keys(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the words lo .. hi of each run, the same wherever the run stands."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    power = np.full(len(hashes) + 1, base, np.uint64)
    back = np.full(len(hashes) + 1, inverse, np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes) * power[:-1])])
    return mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64)).view(np.int64)


def _line_begins(part: Words) -> np.ndarray:
    """Whether a line begins with it, for each word of a slice."""
    data, starts, ends = part.data, part.starts, part.ends
    lo, hi = int(starts[0]), int(ends[-1])
    feeds = np.flatnonzero(data[lo:hi] == 10) + lo
    line = np.ones(len(starts), bool)
    line[1:] = np.searchsorted(feeds, starts[1:]) > np.searchsorted(feeds, ends[:-1])
    line[part.offsets[:-1][part.offsets[:-1] < len(starts)]] = True
    return line


def _anchors(hashes: np.ndarray, rules: PassageRules) -> np.ndarray:
    """Where the anchors of one text begin: the last least run of every ``window`` of them."""
    n = len(hashes) - rules.anchor_words + 1
    if n < rules.window:
        return np.zeros(0, np.int64)
    begin = np.arange(n)
    keys = _run_keys(hashes, begin, begin + rules.anchor_words).view(np.uint64)
    best, place = keys[: n - rules.window + 1].copy(), begin[: n - rules.window + 1].copy()
    for step in range(1, rules.window):
        other = keys[step : step + len(best)]
        less = other <= best
        best[less] = other[less]
        place[less] = begin[step : step + len(best)][less]
    return place[np.concatenate([[True], place[1:] != place[:-1]])]


def _splitter(rules: PassageRules):
    near = rules.near()

    def split(batches):
        hasher = MinHasher(near.bands, near.rows)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for part in words(batch.column("text"), lower=True):
                if len(part.hashes):
                    yield from _units(part, ids, hasher, rules)

    return split


def _units(part: Words, ids: np.ndarray, hasher: MinHasher, rules: PassageRules):
    """Record batches of the paragraphs and the anchors of a slice."""
    line = _line_begins(part)
    n = len(line)
    text = np.repeat(np.arange(len(part)), np.diff(part.offsets))
    keys = np.array([_text_key(part.hashes[a:b]) for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)], np.int64)

    def runs(begins, least):
        lo = np.flatnonzero(begins)
        hi = np.append(lo[1:], n)
        long_enough = hi - lo >= least
        return lo[long_enough], hi[long_enough]

    def columns(lo, hi, is_line, shingles, bands):
        t = text[lo]
        return pa.record_batch(
            {
                "doc_id": pa.array(ids[part.first + t], pa.int64()),
                "text_key": pa.array(keys[t], pa.int64()),
                "line": pa.array(np.full(len(lo), is_line)),
                "lo": pa.array((lo - part.offsets[t]).astype(np.int32)),
                "hi": pa.array((hi - part.offsets[t]).astype(np.int32)),
                "node": pa.array(_run_keys(part.hashes, lo, hi)),
                "n_shingles": pa.array(shingles, pa.int64()),
                "bands": bands if isinstance(bands, pa.Array) else pa.array(bands, pa.list_(pa.int64())),
            }
        )

    found = [_anchors(part.hashes[a:b], rules) + a for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)
             if b - a >= rules.least_marked()]
    lo = np.concatenate(found) if found else np.zeros(0, np.int64)
    yield columns(lo, lo + rules.anchor_words, False, np.zeros(len(lo), np.int64), pa.nulls(len(lo), pa.list_(pa.int64())))
    lo, hi = runs(line, max(rules.passage_words, rules.shingle_words))
    if not len(lo):
        return
    # all shingles of the slice, then those of each paragraph one after another
    size = hi - lo - rules.shingle_words + 1
    begins = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(lo)), size)
    shingles = shingle_hashes(part.hashes, rules.shingle_words)[np.arange(size.sum()) - begins[owner] + lo[owner]]
    order = np.lexsort((shingles, owner))
    new = np.ones(len(order), bool)
    new[1:] = (shingles[order][1:] != shingles[order][:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner, weights=new, minlength=len(lo)).astype(np.int64)
    keys_of = hasher.band_keys_of_runs(shingles, begins)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1) * hasher.bands, pa.int32()), pa.array(keys_of.ravel()))
    yield columns(lo, hi, True, distinct, flat)


def _set_maker(rules: PassageRules):
    def make(batches):
        sketcher = rules.near().sketcher()
        for batch in batches:
            wanted = batch.column("wanted")
            for part in words(batch.column("text"), lower=True):
                nodes, sets, sketches = [], [], []
                for i in range(len(part)):
                    own = part.hashes[part.offsets[i] : part.offsets[i + 1]]
                    key = _text_key(own)
                    for w in wanted[part.first + i].as_py():
                        if w["text_key"] == key:
                            members = np.unique(shingle_hashes(own[w["lo"] : w["hi"]], rules.shingle_words))
                            nodes.append(w["node"])
                            sets.append(members.view(np.int64))
                            sketches.append(sketcher.sketch_of(members))
                yield pa.record_batch(
                    {
                        "node": pa.array(nodes, pa.int64()),
                        "members": pa.array(sets, pa.list_(pa.int64())),
                        "sketch": pa.array(sketches, pa.list_(pa.int64())),
                    }
                )

    return make


# -- removing ---------------------------------------------------------------------


def _cutter(rules: PassageRules):
    def cut(batches):
        for batch in batches:
            texts, cuts = batch.column("text"), batch.column(_CUTS)
            out, removed = [], []
            for part in words(texts, lower=True):
                for i in range(len(part)):
                    row = part.first + i
                    spans = _to_remove(part, i, cuts[row].as_py(), rules)
                    removed.append(sum(b - a for a, b in spans))
                    out.append(_cut(part, i, spans) if spans else texts[row].as_py())
            at = batch.schema.get_field_index("text")
            kept = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            names = [x for x in batch.schema.names if x != _CUTS]
            yield pa.record_batch(
                [*(kept.column(x) for x in names), pa.array(removed, pa.int64())], names=[*names, "removed_words"]
            )

    return cut


def _to_remove(part: Words, i: int, cuts: list[dict] | None, rules: PassageRules) -> list[tuple[int, int]]:
    """Word spans: whole paragraphs, and marked anchors that make a passage."""
    if not cuts:
        return []
    own = part.hashes[part.offsets[i] : part.offsets[i + 1]]
    key = _text_key(own)
    drop, marked = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for c in cuts:
        if c["text_key"] == key:
            for span in c["paragraphs"] or ():
                drop[span["lo"] : span["hi"]] = True
            begins = np.array(c["anchors"] or (), np.int64)
            for step in range(rules.anchor_words):
                marked[begins + step] = True
    # anchors that follow each other begin at most a window apart
    for lo, hi in _spans(~(marked | drop)):
        if lo and hi < len(own) and hi - lo <= max(0, rules.window - rules.anchor_words):
            marked[lo:hi] = True
    for lo, hi in _spans(marked | drop):
        if hi - lo >= rules.least_marked():
            drop[lo:hi] = True
    return _spans(drop)


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _cut(part: Words, i: int, spans: list[tuple[int, int]]) -> str:
    raw = part.data[part.base[i] : part.stops[i]].tobytes()
    first = int(part.offsets[i])
    out, at = b"", 0
    for lo, hi in spans:
        a = int(part.starts[first + lo] - part.base[i])
        b = int(part.ends[first + hi - 1] - part.base[i])
        out += raw[at:a]
        at = b
        rest = raw[b : b + 1]
        # one of the two separators around the gap goes
        if not out or out.endswith(b"\n"):
            while rest and rest in b" \t\v\f\r\n":
                at += 1
                rest = raw[at : at + 1]
        elif out[-1:] in b" \t\v\f\r" and (rest in b" \t\v\f\r\n"):
            out = out.rstrip(b" \t\v\f\r")
    return (out + raw[at:]).decode()
