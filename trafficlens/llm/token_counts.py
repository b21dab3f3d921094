"""Token counts by the whole-token shortcut.

A vocabulary string that the merges of the tokenizer leave as exactly one token is a
whole token. Which strings are is proved once, by running the merges on each entry of
the vocabulary. A pre-token among them counts one; only the others are merged. Equal
words of a slice are counted once, and a worker remembers counts of words, not tokens.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.frames import map_batches
from trafficlens.llm.vocabulary import Alphabet, dictionary_slices

SLICE_BYTES = 1 << 20
# words a worker remembers, and the longest of them in bytes; beyond it starts anew
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64
_SPACES = Alphabet(b" \t\n\v\f\r")
_NOTHING = Alphabet(b"")
_PROVED: dict[str, frozenset[str]] = {}
_LOADED: dict[str, WordCounts] = {}


@dataclass(frozen=True)
class TokenCounts:
    """tokenizer: path of a file of the tokenizers library; limit: tokens of one sequence."""

    tokenizer: str
    limit: int = 2048


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens, in the alphabet of the vocabulary, that are one token each.

    Every vocabulary entry is run through the merges on its own, so nothing is taken on
    trust; an entry that the merges can't reach, or reach only inside a longer
    string, is no whole token. At most as many as the vocabulary has.
    """
    if path not in _PROVED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(Path(path).read_text())["model"].get("end_of_word_suffix") or ""
        found = set()
        for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
            if not entry.endswith(suffix):
                continue
            alone = entry[: len(entry) - len(suffix)]
            tokens = tokenizer.model.tokenize(alone) if alone else []
            if len(tokens) == 1 and tokens[0].id == number:
                found.add(alone)
        _PROVED[path] = frozenset(found)
    return _PROVED[path]


def parts_at_spaces(path: str) -> bool:
    """Whether words between ASCII white space can be counted one by one.

    They can if the pre-tokenizer first keeps only matches of a pattern that has no
    white space in any match: then no token reaches across.
    """
    described = json.loads(Path(path).read_text()).get("pre_tokenizer") or {}
    first = (described.get("pretokenizers") or [described])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    branches = [b for b in pattern.split("|") if b]
    return all(b.startswith(("'", "[\\p{", "[^\\s")) and " " not in b for b in branches)


class WordCounts:
    """Tokens of single words, remembered."""

    def __init__(self, path: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._whole = whole
        described = json.loads(Path(path).read_text())
        self._specials = [
            (s["content"], s["content"].encode()) for s in described.get("added_tokens", [])
        ]
        plain = {t for t in whole if t.isascii() and t.isalpha() and t.islower()}
        # for lower-case ASCII letters the alphabet of the vocabulary is that of the text
        self._plain = dict.fromkeys((t.encode() for t in plain), 1) if self._one_pre_token(plain) else {}
        self._known: dict[bytes, int] = {}

    def _one_pre_token(self, texts: set[str]) -> bool:
        return all(self._pre_tokens(t) == [t] for t in texts)

    @classmethod
    def of(cls, path: str, whole: frozenset[str]) -> WordCounts:
        if path not in _LOADED:
            _LOADED[path] = cls(path, whole)
        return _LOADED[path]

    def _pre_tokens(self, text: str) -> list[str]:
        if self._tokenizer.normalizer is not None:
            text = self._tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _counted(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if any(raw in word for _, raw in self._specials):
            # the library takes added tokens out of the text before anything else
            return len(self._tokenizer.encode(text, add_special_tokens=False).ids)
        whole, merged = self._whole, self._tokenizer.model.tokenize
        return sum(1 if p in whole else len(merged(p)) for p in self._pre_tokens(text))

    def counts(self, words: pa.Array) -> np.ndarray:
        plain, known = self._plain, self._known
        out = np.empty(len(words), np.int64)
        for i, word in enumerate(words.to_pylist()):
            n = plain.get(word) or known.get(word)
            if n is None:
                n = self._counted(word)
                if len(word) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            out[i] = n
        return out


def _counter(how: TokenCounts, whole: frozenset[str], alphabet: Alphabet):
    def count(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = WordCounts.of(how.tokenizer, whole)
        for batch in batches:
            texts = batch.column("text")
            tokens = np.zeros(len(texts), np.int64)
            for part in dictionary_slices(texts, alphabet, SLICE_BYTES):
                # int64 weights would go through doubles, which are exact far beyond a slice
                n = np.bincount(part.texts, counter.counts(part.words)[part.ids], part.n_texts)
                tokens[part.first : part.first + part.n_texts] += n.astype(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    "n_tokens": pa.array(tokens),
                }
            )

    return count


def token_counts(docs: DataFrame, how: TokenCounts) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of ``docs``.

    Tokens are those of the library without begin, end or other added special tokens;
    special strings inside a text are treated as the file says. A null text is empty:
    0 bytes and 0 tokens. Rows without doc_id and repeated rows are counted each by
    itself; columns other than doc_id and text are not read. An empty table gives an
    empty result. A text of any length is read in slices; only a single word without
    white space, or a text for a tokenizer whose tokens reach across white space, is
    held whole. No shuffle.
    """
    alphabet = _SPACES if parts_at_spaces(how.tokenizer) else _NOTHING
    counted = map_batches(
        docs.select("doc_id", "text"),
        _counter(how, whole_tokens(how.tokenizer), alphabet),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long",
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > how.limit)
