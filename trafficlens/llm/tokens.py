"""Token ids of whole texts, word by word with a bounded memory of words."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa

from trafficlens.llm.words import words

# words a worker remembers; beyond it starts anew
REMEMBERED = 1_000_000
_LOADED: dict[str, TokenBytes] = {}


class TokenBytes:
    """Ids as little-endian unsigned 32-bit bytes.

    Only for tokenizers that never join text across white space or between a letter
    or digit and closing punctuation, so that a text's ids are those of its parts one
    after another. Names of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        normalizer = json.loads(Path(path).read_text()).get("normalizer") or {}
        self._lower = any(x.get("type") == "Lowercase" for x in normalizer.get("normalizers", [normalizer]))
        self._known: dict[int, bytes] = {}

    @classmethod
    def of(cls, path: str) -> TokenBytes:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order; none for a null or empty text."""
        for part in words(texts, lower=self._lower, tails=True):
            if len(self._known) > REMEMBERED:
                self._known.clear()
            ids, known = part.hashes.tolist(), self._known
            self._learn(part, set(ids).difference(known))
            for lo, hi in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
                yield b"".join(map(known.__getitem__, ids[lo:hi]))

    def _learn(self, part, unknown: set[int]) -> None:
        hashes = np.sort(np.fromiter(unknown, np.uint64, len(unknown)))
        if not len(hashes):
            return
        # any place where each of them stands
        at = np.minimum(np.searchsorted(hashes, part.hashes), len(hashes) - 1)
        here = np.flatnonzero(hashes[at] == part.hashes)
        place = np.empty(len(hashes), np.int64)
        place[at[here]] = here
        raw, known = memoryview(part.data), self._known
        spans = zip(part.starts[place].tolist(), part.ends[place].tolist(), strict=True)
        found = self._tokenizer.encode_batch_fast([str(raw[a:b], "utf-8") for a, b in spans], add_special_tokens=False)
        for h, encoding in zip(hashes.tolist(), found, strict=True):
            known[h] = array("I", encoding.ids).tobytes()
