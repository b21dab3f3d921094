"""MinHash samples, band keys and odd sketches of hashed sets."""

from __future__ import annotations

import numpy as np

from trafficlens.llm.words import mix

SKETCH_WORDS = 32
SKETCH_BITS = 64 * SKETCH_WORDS
_BLOCK = 4096
_HASHES_AT_ONCE = 1 << 22


class MinHasher:
    """``bands`` keys of ``rows`` samples each.

    Two sets with similarity s share a key with probability 1 - (1 - s^rows)^bands.
    An odd sketch of the samples has ``sketch_bits``.
    """

    def __init__(self, bands: int, rows: int, seed: int = 7, sketch_bits: int = SKETCH_BITS):
        self.bands, self.rows, self.sketch_bits = bands, rows, sketch_bits
        rng = np.random.default_rng(seed)
        n = self.n = bands * rows
        self._a = (rng.integers(0, 1 << 31, n, dtype=np.uint32) * 2 + 1)[:, None]
        self._b = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self._row = rng.integers(0, 1 << 62, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._band = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self._sample = mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(1 << 40))

    def samples(self, members: np.ndarray) -> np.ndarray:
        """The smallest hash of a non-empty set under each hash function."""
        x = (members >> np.uint64(32)).astype(np.uint32)
        best = None
        step = min(_BLOCK, max(1, _HASHES_AT_ONCE // self.n))
        for lo in range(0, len(x), step):
            hashed = self._a * x[None, lo : lo + step]
            hashed += self._b
            least = hashed.min(axis=1)
            best = least if best is None else np.minimum(best, least)
        return best

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        wide = samples.astype(np.uint64).reshape(self.bands, self.rows)
        return mix((mix(wide) * self._row).sum(axis=1, dtype=np.uint64) + self._band).view(np.int64)

    def band_keys_of_runs(self, members: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row of band keys for each run members[begins[i] : begins[i + 1]], none of them empty.

        A run may hold a member several times.
        """
        x = (members >> np.uint64(32)).astype(np.uint32)
        keys = np.empty((len(begins), self.bands), np.uint64)
        for band in range(self.bands):
            total = np.full(len(begins), self._band[band])
            for row in range(self.rows):
                k = band * self.rows + row
                least = np.minimum.reduceat(x * self._a[k, 0] + self._b[k, 0], begins)
                total += mix(least.astype(np.uint64)) * self._row[band, row]
            keys[:, band] = mix(total)
        return keys.view(np.int64)

    def sketch_of(self, members: np.ndarray) -> np.ndarray:
        return self.odd_sketch(self.samples(members)) if len(members) else np.zeros(self.sketch_bits // 64, np.int64)

    def odd_sketch(self, samples: np.ndarray) -> np.ndarray:
        """A bitmap in which each (function, sample) pair flips one bit.

        The XOR of two sketches holds the parities of the samples that differ.
        """
        bits = mix(samples.astype(np.uint64) + self._sample) % np.uint64(self.sketch_bits)
        odd = (np.bincount(bits.astype(np.int64), minlength=self.sketch_bits) & 1).astype(np.uint8)
        return np.packbits(odd, bitorder="little").view(np.int64)

    def most_odd_bits(self, similarity: float, deviations: float = 5.0) -> int:
        """XOR bits that lie ``deviations`` above those of a pair of this similarity.

        Both the number of samples that differ and the bits that their flips leave odd
        vary. In a simulation with 1000 samples none of 500,000 pairs at 0.8 exceeded it.
        """
        flips = 2 * self.n * (1 - similarity)
        # mean over one and over two bits of the sign that each flip turns
        one, two = (1 - 2 / self.sketch_bits) ** flips, (1 - 4 / self.sketch_bits) ** flips
        odd = (1 - one) / 2
        occupied = self.sketch_bits * odd * (1 - odd) + self.sketch_bits * (self.sketch_bits - 1) * (two - one**2) / 4
        differing = self.n * similarity * (1 - similarity) * (2 * one) ** 2
        return int(np.ceil(self.sketch_bits * odd + deviations * np.sqrt(differing + occupied)))
