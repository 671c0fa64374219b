"""Passages of held-out test items that stand in documents, found through an FM-index of each shard.

A shard of documents is a sequence of word numbers. Its FM-index holds the Burrows-Wheeler transform in a
wavelet matrix, whose ranks answer a backward search, and a sample of the suffix positions, from which every
occurrence is located. The phrases searched are all runs of k words of the test items; runs found at adjoining
positions are merged into the spans to remove.

Words that occur in no test item cannot be in a match; they only separate, and runs between them that are
shorter than k words are left out of the index. This makes the index small but ties it to the items: it serves one
pass of them and is not kept. The whole text is read; nothing that could match is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .words import WORD, visible

#: Words of text in a shard, which bounds a task's memory; a longer document is cut with overlap.
SHARD_WORDS = 400_000
#: Every so many positions of the text have their suffix position kept.
SAMPLE = 16
#: Bytes of test items that are searched in one pass; more are searched in several. A word takes at least two bytes, so a
#: pass has at most half as many phrases, each k + 2 numbers of 4 bytes where it is held: 126 MB for phrases of one-letter
#: words, about 40 MB for texts of natural language, on the driver and in each worker alike.
ITEM_BYTES = 4 << 20


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes, by prefix doubling."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    order, h = np.argsort(rank, kind="stable"), 1
    while True:
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1 if h < n else 0
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or h >= n:
            return order
        h *= 2


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit of the symbol a level."""

    def __init__(self, seq: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        seq = seq.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ((symbol >> b) & 1) == 1
            a, z = ones[lo], ones[hi]
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + z, hi - z)
        return hi - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        out, i = np.zeros_like(i), i.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = (ones[i + 1] - ones[i]).astype(np.int64)
            out |= bit << b
            i = np.where(bit == 1, zeros + ones[i], i - ones[i])
        return out


class FMIndex:
    """Index of a sequence of numbers from 1 to size - 1; 0, which ends it, must stand nowhere else, or walks would go astray."""

    def __init__(self, seq: np.ndarray, size: int):
        seq = np.append(seq, 0).astype(np.int64)
        sa = suffix_array(seq)
        self.n = len(seq)
        bwt = seq[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=size)))).astype(np.int64)
        self.wavelet = WaveletMatrix(bwt, size)
        kept = sa % SAMPLE == 0
        self.kept = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of the suffixes that begin with each row of phrases; empty where there is none."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k].astype(np.int64)
            base = self.first[c]
            low[live], high[live] = base + self.wavelet.rank(c, low[live]), base + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back from each to a sampled one."""
        out, steps, live, rows = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            at = rows[live]
            hit = self.kept[at + 1] > self.kept[at]
            done = live[hit]
            out[done] = self.samples[self.kept[rows[done]]] + steps
            live = live[~hit]
            c = self.wavelet.at(rows[live])
            rows[live] = self.first[c] + self.wavelet.rank(c, rows[live])
            steps += 1
        return out % self.n


class Phrases:
    """All runs of k words of a set of items, each once, with the items that hold it: arrays only, beside the words' numbers."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k = k
        self.number: dict[str, int] = {}
        runs, owners, names = [np.zeros((0, k), np.int32)], [np.zeros(0, np.int32)], []
        for item, text in items:
            ws = WORD.findall(visible(text).casefold())
            if len(ws) < k:
                continue
            codes = np.array([self.number.setdefault(w, len(self.number) + 2) for w in ws], np.int32)  # 1 separates
            runs.append(np.lib.stride_tricks.sliding_window_view(codes, k))
            owners.append(np.full(len(ws) - k + 1, len(names), np.int32))
            names.append(item)
        every, owner = np.concatenate(runs), np.concatenate(owners)
        keys = np.ascontiguousarray(every).view(np.dtype((np.void, 4 * k))).reshape(-1)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        #: The phrases, a row each.
        self.rows = every[first]
        # the items of phrase p stand in names[held[starts[p]:starts[p + 1]]]
        pairs = np.unique(which.astype(np.int64) * max(1, len(names)) + owner)
        self.held = (pairs % max(1, len(names))).astype(np.int32)
        self.starts = np.searchsorted(pairs, np.arange(len(first) + 1, dtype=np.int64) * max(1, len(names)))
        self.names = np.array(names, np.int64)
        self.size = len(self.number) + 2

    def items(self, phrase: int) -> list[int]:
        return self.names[self.held[self.starts[phrase] : self.starts[phrase + 1]]].tolist()


def _pieces(text: str, phrases: Phrases) -> Iterator[tuple[int, np.ndarray]]:
    """(word position, numbers) of each run of known words that is long enough; long ones in overlapping parts."""
    get = phrases.number.get
    codes = np.fromiter((get(w, 0) for w in WORD.findall(visible(text).casefold())), np.int64)
    known = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
    for a, b in zip(known[::2], known[1::2], strict=True):
        while b - a >= phrases.k:
            yield int(a), codes[a : min(b, a + SHARD_WORDS)]
            a += SHARD_WORDS - phrases.k + 1


def spans(docs: list[tuple[int, list[tuple[int, np.ndarray]]]], phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, word after the last) of each merged span, by one index over the documents' pieces."""
    parts, starts, owners, at = [], [], [], 0
    for doc, pieces in docs:
        for position, codes in pieces:
            parts += [codes, np.ones(1, np.int64)]
            starts.append(at)
            owners.append((doc, position))
            at += len(codes) + 1
    if not parts or not len(phrases.rows):
        return
    index = FMIndex(np.concatenate(parts), phrases.size)
    low, high = index.search(phrases.rows)
    hits = np.flatnonzero(high > low)
    if not len(hits):
        return
    counts = (high - low)[hits]
    which = np.repeat(hits, counts)
    rows = np.repeat(low[hits] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    where = index.locate(rows)
    piece = np.searchsorted(np.array(starts), where, side="right") - 1
    found: dict[tuple[int, int], list[int]] = {}
    for p, w, pos in zip(piece.tolist(), which.tolist(), where.tolist(), strict=True):
        doc, begin = owners[p]
        for item in phrases.items(w):
            found.setdefault((doc, item), []).append(begin + pos - starts[p])
    for (doc, item), positions in found.items():
        a = b = -1
        for x in sorted(positions):
            if x > b:
                if b >= 0:
                    yield doc, item, a, b
                a = x
            b = x + phrases.k
        yield doc, item, a, b


_SPANS = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32())])


def _find(phrases):
    def run(batches):
        def flush(docs):
            out = list(spans(docs, phrases.value))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SPANS.types, strict=True)], schema=_SPANS)

        docs, held = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in _pieces(text.as_py() or "", phrases.value):
                    docs.append((i, [piece]))
                    held += len(piece[1])
                    if held >= SHARD_WORDS:
                        yield flush(docs)
                        docs, held = [], 0
        if docs:
            yield flush(docs)

    return run


def leaks(documents: DataFrame, id_col: str, text: str, items: DataFrame, item_col: str, item_text: str, k: int = 13) -> DataFrame:
    """(id, item_id, first_word, end_word): the spans of documents that share at least k consecutive words with an item.

    Words are as in words.py, by case folding, invisible characters dropped. Spans count the document's words from 0;
    overlapping spans of an item are merged (a cut document of more than SHARD_WORDS words may have a span in two
    parts). Null and empty texts, and items of fewer than k words, match nothing; equal items each match. One pass over
    the documents without a shuffle for each ITEM_BYTES of items, which are all that is broadcast.
    """
    sc = documents.sparkSession.sparkContext
    docs = spread(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")))
    own = items.select(F.col(item_col).cast("long").alias("item"), F.coalesce(item_text, F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = int(size // ITEM_BYTES) + 1
    out = None
    for p in range(passes):
        part = own if passes == 1 else own.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        phrases = sc.broadcast(Phrases([(r[0], r[1]) for r in part.collect()], k))
        one = docs.mapInArrow(_find(phrases), "id long, item_id long, first_word int, end_word int")
        out = one if out is None else out.unionByName(one)
    return out
