"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the symbols of a clause: one adds up insults, one adds up
threats, one notices whom the clause addresses, one whether it negates, one whether it
reports what others said. Their product reads a clause once and ends in a state that
says how the clause's weight counts: more with a target, less under negation, least as
reported speech. Words of insult and their weights are learned from labels; the small
words of the other transducers are fixed. A document's score comes from its weightiest
clause and the number of matched clauses, by a logistic curve fitted to labels.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.frames import map_batches, stored, temporary, with_fields
from trafficlens.llm.language import held_out
from trafficlens.llm.words import shingle_hashes, words

# Words of the grammar in English, German, French and Spanish.
TARGETS = (
    "you your yourself he she they him her them his their this these those du dich dir dein ihr euch sie "
    "er dieser diese tu toi vous ton votre il elle ils ce cette tú usted ustedes tu él ella ellos este esta"
)
NEGATIONS = "not no never nobody isn't aren't wasn't don't nicht kein keine nie niemals pas ne jamais aucun nunca jamás ningún"
REPORTS = (
    "said says say called calls wrote writes claimed claims reported quoted sagte sagt nannte schrieb behauptet "
    "dit appelé écrit affirme dijo dice llamó escribió afirma"
)
THREATS = "kill hurt destroy burn beat punch stab shoot töten schlagen verbrennen tuer frapper brûler matar golpear quemar"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
WORD = regex.compile(r"[\p{L}']+")
CLAUSE_END = frozenset(b".,;:!?")
PREFIXES = (4, 5, 6)
_REMEMBERED = 500_000
_FEATURES = ("best", "matched", "n_words")


@dataclass(frozen=True)
class Grammar:
    """Factors of a clause's weight and what learning asks for.

    least_weight: a term is an insult if its log odds in toxic against other documents,
    less twice their standard error, reach it. threat_weight: weight of a threat word.
    labelled_rows: learning takes at most so many labels, the first by a hash of the id.
    """

    targeted: float = 1.25
    negated: float = 0.6
    reported: float = 0.4
    threat_weight: float = 2.0
    labelled_rows: int = 150_000
    least_weight: float = 1.5
    ridge: float = 0.01


def _transducer(*moves: tuple[int, int, int], states: int) -> np.ndarray:
    """Next state by (state, symbol); symbols without a move leave the state."""
    table = np.repeat(np.arange(states)[:, None], 6, axis=1)
    for state, symbol, to in moves:
        table[state, symbol] = to
    return table


INSULTS = _transducer((0, INSULT, 1), states=2)
THREATENS = _transducer((0, THREAT, 1), states=2)
ADDRESSES = _transducer((0, TARGET, 1), states=2)
# a negation counts for what follows it in the clause; one after the insult does not
NEGATES = _transducer((0, NEGATION, 1), (0, INSULT, 2), (0, THREAT, 2), states=3)
REPORTS_SPEECH = _transducer((0, REPORT, 1), states=2)


def composed(*parts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product of transducers over one input: its table, and what each state is made of."""
    states = list(itertools.product(*(range(len(p)) for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    table = np.array([[number[tuple(int(p[s][x]) for p, s in zip(parts, state, strict=True))] for x in range(6)] for state in states])
    return table, states


def clause_factors(how: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """The composed table, and by final state the factor of the clause's weight (0: no match)."""
    table, states = composed(INSULTS, THREATENS, ADDRESSES, NEGATES, REPORTS_SPEECH)
    factors = []
    for insult, threat, target, negation, report in states:
        factor = float(bool(insult or threat))
        factor *= how.targeted if target else 1.0
        factor *= how.negated if negation == 1 else 1.0
        factor *= how.reported if report else 1.0
        factors.append(factor)
    return table, np.array(factors)


# -- learning ---------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, how: Grammar) -> DataFrame:
    """(text, toxic) of labelled rows that are not held out, one of each group of close copies.

    Copies share the smallest hash of their five-word shingles; of rows that do, one for
    each label stays, so that a text copied a thousand times counts about once.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    given = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.labelled_rows)
    # two numbers a row: a few MB at most, so no text is shuffled to find its label
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    keyed = map_batches(rows.select("text", "toxic"), _smallest_shingle, "text string, toxic int, key long")
    return keyed.groupBy("key", "toxic").agg(F.first("text").alias("text")).select("text", "toxic")


def _smallest_shingle(batches):
    for batch in batches:
        keys = []
        for part in words(batch.column("text"), lower=True):
            for i in range(len(part)):
                own = part.hashes[part.offsets[i] : part.offsets[i + 1]]
                keys.append(int(shingle_hashes(own, 5).min().view(np.int64)) if len(own) else 0)
        yield pa.record_batch(
            {"text": batch.column("text"), "toxic": batch.column("toxic").cast(pa.int32()), "key": pa.array(keys, pa.int64())}
        )


def terms(word: str) -> list[str]:
    """A lower-case word and its beginnings, which stand for all words that begin so."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def learned_terms(rows: DataFrame, how: Grammar) -> DataFrame:
    """(term, weight) of the terms of insult in ``rows`` (text, toxic).

    A beginning has to earn its weight without the most frequent of its words.
    """
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = map_batches(rows, _count_words, "word string, toxic int, n long").groupBy("word")
    by_word = stored(
        counts.agg(
            F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("toxic") > 0, 0).otherwise(F.col("n"))).alias("good"),
        ),
        "words",
    )
    beginnings = F.explode(F.array(*(F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in PREFIXES)))
    by_beginning = (
        by_word.select(beginnings.alias("term"), "bad", "good")
        .filter("term IS NOT NULL")
        .groupBy("term")
        .agg((F.sum("bad") - F.max("bad")).alias("bad"), F.sum("good").alias("good"))
    )
    every = by_word.select(F.col("word").alias("term"), "bad", "good").union(by_beginning)
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(bad / (n.get(1, 0) + 1)) - F.log(good / (n.get(0, 0) + 1))
    error = F.sqrt(1 / bad + 1 / good)
    return every.select("term", (odds - 2 * error).alias("weight")).filter(F.col("weight") >= how.least_weight)


def _count_words(batches):
    def rows(counted):
        keys = list(counted)
        return pa.record_batch(
            {
                "word": pa.array([k[0] for k in keys], pa.string()),
                "toxic": pa.array([k[1] for k in keys], pa.int32()),
                "n": pa.array([counted[k] for k in keys], pa.int64()),
            }
        )

    counted: dict[tuple[str, int], int] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            for word in set(WORD.findall((text.as_py() or "").lower())):
                counted[word, toxic] = counted.get((word, toxic), 0) + 1
            if len(counted) > _REMEMBERED:
                yield rows(counted)
                counted = {}
    yield rows(counted)


# -- scoring ----------------------------------------------------------------------


class _Reader:
    """Finds the weightiest clause and the number of matched clauses of texts."""

    def __init__(self, weights: dict[str, float], how: Grammar):
        self._weights, self._how = weights, how
        self._table, self._factors = clause_factors(how)
        fixed = {TARGET: TARGETS, NEGATION: NEGATIONS, REPORT: REPORTS, THREAT: THREATS}
        self._fixed = {w: symbol for symbol, text in fixed.items() for w in text.split()}
        self._known: dict[int, tuple[int, float, bool]] = {}

    def _symbol(self, raw: bytes) -> tuple[int, float, bool]:
        """Symbol and weight of a word, and whether a clause ends with it."""
        ends = raw[-1] in CLAUSE_END
        best = (OTHER, 0.0)
        for word in WORD.findall(raw.decode().lower()):
            insult = max((self._weights.get(t, 0.0) for t in terms(word)), default=0.0)
            if insult > 0:
                best = (INSULT, insult)
                break
            if word in self._fixed and best[0] == OTHER:
                symbol = self._fixed[word]
                best = (symbol, self._how.threat_weight if symbol == THREAT else 0.0)
        return *best, ends

    def features(self, texts: pa.Array):
        """(weight of the weightiest clause, matched clauses, words) of each text."""
        for part in words(texts):
            if len(self._known) > _REMEMBERED:
                self._known.clear()
            hashes, first, place = np.unique(part.hashes, return_index=True, return_inverse=True)
            raw, known = memoryview(part.data), self._known
            for h, i in zip(hashes.tolist(), first.tolist(), strict=True):
                if h not in known:
                    known[h] = self._symbol(bytes(raw[part.starts[i] : part.ends[i]]))
            found = [known[h] for h in hashes.tolist()]
            symbol = np.array([s for s, _, _ in found], np.int64)[place] if found else np.zeros(0, np.int64)
            weight = np.array([w for _, w, _ in found])[place] if found else np.zeros(0)
            ends = np.array([e for _, _, e in found], bool)[place] if found else np.zeros(0, bool)
            if len(ends):
                ends[:-1] |= self._line_ends(part)
            yield from self._of_texts(part, symbol, weight, ends)

    def _line_ends(self, part) -> np.ndarray:
        """Whether a line feed follows each word but the last of the slice."""
        lo = int(part.starts[0])
        feeds = np.concatenate([[0], np.cumsum(part.data[lo : int(part.ends[-1])] == 10)])
        return feeds[part.starts[1:] - lo] > feeds[part.ends[:-1] - lo]

    def _of_texts(self, part, symbol, weight, ends):
        clause = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else np.zeros(0, np.int64)
        hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        text_of = np.searchsorted(part.offsets, hits, side="right") - 1
        best, matched = np.zeros(len(part)), np.zeros(len(part), np.int64)
        done = (-1, -1)
        for at, text in zip(hits.tolist(), text_of.tolist(), strict=True):
            if done == (text, int(clause[at])):
                continue
            done = (text, int(clause[at]))
            lo = max(int(np.searchsorted(clause, clause[at])), int(part.offsets[text]))
            hi = min(int(np.searchsorted(clause, clause[at], side="right")), int(part.offsets[text + 1]))
            own = symbol[lo:hi]
            state = 0
            for s in own[own != OTHER].tolist():
                state = self._table[state, s]
            value = self._factors[state] * float(weight[lo:hi].sum())
            best[text] = max(best[text], value)
            matched[text] += value > 0
        return zip(best.tolist(), matched.tolist(), np.diff(part.offsets).tolist(), strict=True)


def _feature_frame(docs: DataFrame, weights, how: Grammar) -> DataFrame:
    def read(batches):
        reader = _Reader(weights.value, how)
        for batch in batches:
            found = list(reader.features(batch.column("text")))
            kinds = (pa.float64(), pa.int64(), pa.int64())
            arrays = [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([*batch.columns, *arrays], names=[*batch.schema.names, *_FEATURES])

    return map_batches(docs, read, with_fields(docs, best="double", matched="long", n_words="long"))


def _inputs(best, matched, n_words):
    """The four inputs of the curve; all level off. Length only counts beside a match."""
    some = F.least(matched, F.lit(64)).cast("double")
    length = F.when(some > 0, F.log1p(F.least(n_words, F.lit(1_000_000)).cast("double"))).otherwise(0.0)
    return [F.lit(1.0), F.least(best, F.lit(16.0)) / 4, F.log1p(some), length / 4]


def fitted_curve(rows: DataFrame, how: Grammar) -> list[float]:
    """Weights of the inputs, by Newton steps over counts on a grid of bounded size."""
    best = F.round(F.least("best", F.lit(16.0)) * 4) / 4
    words_log = F.round(F.log2(F.least("n_words", F.lit(1_000_000)) + 1) * 2) / 2
    cells = rows.groupBy(
        best.alias("best"),
        F.least("matched", F.lit(64)).alias("matched"),
        (F.pow(F.lit(2.0), words_log) - 1).alias("n_words"),
        "toxic",
    ).agg(F.count("*").alias("n"))
    inputs = _inputs(F.col("best"), F.col("matched"), F.col("n_words"))
    got = cells.select(*(x.alias(f"x{i}") for i, x in enumerate(inputs)), "toxic", "n").toPandas()
    x = got[[f"x{i}" for i in range(len(inputs))]].to_numpy(float)
    y, n = (got["toxic"] > 0).to_numpy(float), got["n"].to_numpy(float)
    w = np.zeros(len(inputs))
    if not len(got):
        return w.tolist()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + how.ridge * w
        curvature = (x.T * (n * p * (1 - p))) @ x + how.ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def toxicity(docs: DataFrame, labels: DataFrame, how: Grammar = Grammar()) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) with held_out and score (0 to 1).

    Learns from ``labels`` (doc_id, toxic) of rows that are not held out. A null or
    empty text has no clause and the score of texts without a match. Without labels the
    score of every text is 0.5. Rows are scored one by one, by their text alone; columns
    of the input with these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("held_out", "score", *_FEATURES)]
    with temporary(docs):
        rows = stored(training_rows(docs, labels, how), "toxic-training")
        lexicon = stored(learned_terms(rows, how), "insults")
        spark = docs.sparkSession
        # a term needs proof from labelled text: as many as labels can prove, each a word or a word's beginning
        weights = spark.sparkContext.broadcast({r.term: r.weight for r in lexicon.toLocalIterator()})
        curve = fitted_curve(_feature_frame(rows, weights, how), how)
    scored = _feature_frame(docs.select(*kept), weights, how)
    inner = sum((w * x for w, x in zip(curve, _inputs(*map(F.col, _FEATURES)), strict=True)), F.lit(0.0))
    return scored.select(*kept, held_out().alias("held_out"), (1 / (1 + F.exp(-inner))).alias("score"))
