"""Code points of texts as numpy arrays, with lower case and letter tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# letters beyond this code point are not told from other characters
KNOWN = 0x32000
SPACE = 32


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The lower-case letter for a letter's code point, 32 (a space) for all else."""
    table = np.full(KNOWN + 1, SPACE, np.uint32)
    for code in range(KNOWN):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def folded_words(text: str | None) -> np.ndarray:
    """Lower-case letters with exactly one space before, between and after words."""
    plain = letters()[np.minimum(code_points(text), KNOWN)]
    padded = np.concatenate([[SPACE], plain, [SPACE]]).astype(np.uint64)
    return padded[np.concatenate([[True], (padded[1:] != SPACE) | (padded[:-1] != SPACE)])]
