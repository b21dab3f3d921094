"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language in order. A text's own list
is compared with each profile: every n-gram adds the difference of its two places,
or the length of the profile if the language lacks it. The least sum wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.chars import SPACE, folded_words
from trafficlens.llm.frames import crc_fold, map_batches, stored, temporary, with_fields

UNDETERMINED = "und"
HELD_OUT_FOLD = 2


@dataclass(frozen=True)
class Profiles:
    """n-grams of one to three letters, with a space for a word's edge.

    places: length of a language's profile. text_places: how many of a text's own
    n-grams are compared; more than places would only count n-grams seen once.
    """

    places: int = 400
    text_places: int = 400


def held_out():
    """Rows never learned from: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(crc_fold("doc_id") == HELD_OUT_FOLD, F.lit(False))


def grams(text: str | None) -> np.ndarray:
    """All n-grams as numbers: three code points of 21 bits, missing ones zero."""
    x = folded_words(text)
    if len(x) < 3:
        return np.zeros(0, np.uint64)
    two = (x[:-1] << np.uint64(21)) | x[1:]
    three = (two[:-1] << np.uint64(21)) | x[2:]
    return np.concatenate([x[x != SPACE], two, three])


def learned_profiles(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """(lang, gram, place) from ``docs`` (text, lang); rows without either are left out.

    Sums over all rows: each batch sends the counts of its n-grams, which are added
    up by language and n-gram. Equal counts stand in the order of the n-gram.
    """
    given = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = map_batches(given, _count, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = total.withColumn("place", F.row_number().over(order) - 1)
    return ranked.filter(F.col("place") < how.places).select("lang", "gram", "place")


def _count(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("text")
        names, out = [], []
        for lang in sorted(set(langs)):
            parts, size = [], 0
            for i in np.flatnonzero(langs == lang).tolist() + [None]:
                if i is not None:
                    parts.append(grams(texts[i].as_py()))
                    size += len(parts[-1])
                if parts and (i is None or size > 1 << 22):
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    names.append((lang, len(gram)))
                    out.append((gram, n))
                    parts, size = [], 0
        yield pa.record_batch(
            {
                "lang": pa.array([x for x, n in names for _ in range(n)], pa.string()),
                "gram": pa.array(np.concatenate([g for g, _ in out]).view(np.int64) if out else [], pa.int64()),
                "n": pa.array(np.concatenate([n for _, n in out]) if out else [], pa.int64()),
            }
        )


def identified(docs: DataFrame, profiles: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """All columns of ``docs`` (text) with lang_pred and score.

    A null text or one without a letter is "und" with score 0, also when no profile was
    learned. score is the lead over the second language as a share of its distance (of
    the largest possible one with a single language). Equal distances go to the first
    language by name. Columns of the input with these names are replaced.
    """
    # at most ``places`` rows for each language
    table = {}
    for row in profiles.orderBy("lang", "place").toLocalIterator():
        table.setdefault(row.lang, []).append(row.gram)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = with_fields(docs.select(*kept), lang_pred="string", score="double")
    model = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in sorted(table.items())})
    return map_batches(docs.select(*kept), _scorer(model, how), schema)


def _scorer(model, how: Profiles):
    def score(batches):
        names = list(model.value)
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *model.value.values()])).view(np.uint64)
        known.sort()
        # place of each known n-gram in each language
        places = np.full((len(names), len(known) + 1), how.places, np.int64)
        for k, own in enumerate(model.value.values()):
            places[k, np.searchsorted(known, own.view(np.uint64))] = np.arange(len(own))
        for batch in batches:
            found = [_nearest(text.as_py(), names, known, places, how) for text in batch.column("text")]
            arrays = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.record_batch([*batch.columns, *arrays], names=[*batch.schema.names, "lang_pred", "score"])

    return score


def _nearest(text, names, known, places, how: Profiles) -> tuple[str, float]:
    own = grams(text)
    if not len(own) or not names:
        return UNDETERMINED, 0.0
    gram, n = np.unique(own, return_counts=True)
    top = np.argsort(-n, kind="stable")[: how.text_places]
    gram = gram[top]
    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
    at[known[at] != gram] = len(known)
    theirs = places[:, at]
    off = np.where(theirs < how.places, np.abs(theirs - np.arange(len(gram))), how.places)
    distance = off.sum(axis=1)
    order = np.argsort(distance, kind="stable")
    best = distance[order[0]]
    second = distance[order[1]] if len(order) > 1 else how.places * len(gram)
    return names[order[0]], float((second - best) / second) if second else 0.0


def language_of(docs: DataFrame, how: Profiles = Profiles()) -> DataFrame:
    """Learn from the rows that are not held out, then identify all of them.

    Returns all columns of ``docs`` (doc_id, text, lang) with held_out, lang_pred and score.
    """
    marked = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", held_out())
    with temporary(docs):
        # read while the answer is being planned, not afterwards
        profiles = stored(learned_profiles(marked.filter("NOT held_out"), how), "profiles")
        return identified(marked, profiles, how)
