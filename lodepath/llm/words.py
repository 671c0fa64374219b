"""Words of marked-up text, and 64-bit hashes of words and of runs of words."""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np

TAG = re.compile(r"<[^>]*>")
WORD = re.compile(r"[^\W_]+")
#: Zero-width characters, soft hyphens and the like.
INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")

#: Words remembered by a worker; beyond, the memory starts anew.
MEMORY = 500_000


def plain(text: str | None) -> str:
    """Tags become blanks, then entities their characters."""
    return html.unescape(TAG.sub(" ", text)) if text else ""


def visible(text: str | None) -> str:
    """As plain(), without invisible characters, whether written out or as entities."""
    return INVISIBLE.sub("", plain(INVISIBLE.sub("", text))) if text else ""


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


class Hasher:
    """64-bit hashes of words, the same on every machine."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in set(found).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix(out + hashes[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
    return out
