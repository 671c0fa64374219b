"""Near-duplicate records: a set-similarity join by token-combination prefixes.

Each record is the set of its runs of k words (tokens). Records with equal sets form a class and only
one of a class takes part; the copies come back at the end. Signatures are single tokens where they are
rare and combinations of tokens where they are frequent; records that share enough signatures are
verified on the whole sets. No bucket, candidate or partner is capped. There are two ways to choose them.

dealt (the default): several times over, tokens are dealt into groups by a hash of the round. A group's
signature is its first tokens in hash order, extended until the combination is expected in less than RARE
records: a rare token stands alone, frequent ones are joined by a second, a third and so on; a group that
runs out of tokens ends its signature with a mark. Two records agree on a combination of k tokens with a
probability of about J^k. k grows with the logarithm of the records and with the tokens' frequency, so the number of
signatures is chosen for each record (see wanted_signatures): as many as keep the chance that a pair at the
threshold shares less than SHARED of them within MISS, whichever tokens were edited. Records that would need
more than MOST, and those so short that a partner may have less than LARGE tokens, are also indexed by the exact
scheme; a pair that the dealt signatures of both records do not bound has two such records.

exact: all tokens have one global order, rare ones first, and a record's prefix is the start of its tokens.
A record within the threshold can miss at most d of them. Tokens of a rare class are indexed by themselves;
tokens of a frequent class are dealt into groups and each combination of k tokens of a group is indexed. To
break all combinations of a group with m tokens, m - k + 1 of them must be missing; so such a group counts
m - k + 1 towards what a prefix needs, and it is extended until it has d + c. A pair within the threshold
then shares at least c signatures for certain. At low thresholds this indexes several times as much.

Frequencies come from a sketch of fixed size (one count for each of 2^20 hash buckets, over one record of
each class: copies do not make a token frequent); it only steers how far combinations are extended, which must agree between records but need not be exact.
Texts are read once more for each step that needs their tokens, which costs less than moving them.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import materialise, small_join, spread
from .words import Hasher, mix, plain, runs, words

SKETCH_BITS, SKETCH_BLOCKS = 20, 64
#: dealt: records in which a combination is expected; signatures of a record at least; how many a pair must share; tokens in a group, so that few groups run out.
RARE, SIGNATURES, SHARED, GROUP = 0.1, 96, 3, 8
#: dealt: chance to miss a pair at the threshold, at most; signatures of a record up to which more of them are taken; cells of a combination's log share.
MISS, MOST, CELLS = 1e-5, 512, 48
#: Pairs whose smaller record has fewer tokens are found by the exact scheme alone.
LARGE = 64
#: exact: a token in at most so many records is indexed by itself; signatures that a pair shares at least, where records are long enough.
SINGLE, NEED = 8, 8
#: Ids up to which a set of them is broadcast (a long each); beyond, it is joined by shuffle.
BROADCAST_IDS = 1_000_000


def _tokens(hasher: Hasher, text: str, k: int) -> np.ndarray:
    return np.unique(runs(hasher(words(plain(text))), k))


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _first_pass(k: int):
    """Digest and size of each record's set."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                sets = [_tokens(hasher, x, k) for x in batch.column(1).slice(start, 2000).to_pylist()]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                cols = [batch.column(0).slice(start, len(sets)), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "n"])

    return run


def _sketch(k: int):
    """Once for each task, its blocks of the frequency sketch of the records given: one of each class, so that copies do not count."""

    def run(batches):
        hasher, counts, any_row = Hasher(), np.zeros(1 << SKETCH_BITS, np.uint32), False
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                sets = [_tokens(hasher, x, k) for x in batch.column(1).slice(start, 2000).to_pylist()]
                any_row = True
                counts += np.bincount(_bucket(np.concatenate(sets)), minlength=1 << SKETCH_BITS).astype(np.uint32)
        if any_row:
            blocks = [x.tobytes() for x in np.split(counts, SKETCH_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "counts"])

    return run


def _add_blocks(pdf):
    total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in pdf["counts"])
    pdf = pdf.iloc[:1].copy()
    pdf["counts"] = [np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32).tobytes()]
    return pdf


def _sum_sketch(parts: DataFrame) -> np.ndarray:
    """Counts of all tokens by hash bucket: 4 MB whatever the data.

    Each task has sent 64 blocks; they are added on the executors in two steps, in groups of about 256 however many
    tasks there were, and 64 rows come to the driver.
    """
    salts = max(1, -(-parts.filter("block = 0").count() // 256))
    salted = parts.withColumn("salt", (F.rand(3) * salts).cast("int"))
    once = salted.groupBy("block", "salt").applyInPandas(lambda pdf: _add_blocks(pdf)[["block", "counts"]], "block int, counts binary")
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint32)
    for r in once.groupBy("block").applyInPandas(_add_blocks, "block int, counts binary").collect():
        out[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)


def at_least(threshold: float, n):
    """Tokens of a set of size n that a smaller partner must share."""
    return np.ceil(threshold * n - 1e-9)


class Scheme:
    """How records of sizes in [low, high) are indexed."""

    def __init__(self, number: int, low: int, high: int, threshold: float):
        self.number, self.low, self.high = number, low, high
        shared = int(at_least(threshold, low))
        #: Signatures that a pair within the threshold shares at least.
        self.need = max(1, min(NEED, shared // 8))
        loss = shared - self.need
        self.triples = loss // 6
        self.pairs = loss - 2 * self.triples


def schemes(smallest: int, largest: int, threshold: float) -> list[Scheme]:
    """Size bands that grow by 1/threshold^2; a pair is looked for in the band of its smaller record."""
    out, low = [], max(1, smallest)
    while low <= largest:
        high = max(low + 1, math.floor(low / threshold**2))
        out.append(Scheme(len(out), low, high, threshold))
        low = high
    return out


def signatures(tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray, classes: int, threshold: float, bands: list[Scheme]):
    """(record, signature, small) of the records whose sorted token sets are laid end to end.

    small: the signature also stands in the shorter prefix that a pair's smaller record needs.
    """
    rec = np.repeat(np.arange(len(sizes)), sizes)
    freq = counts[_bucket(tokens)]
    order = np.lexsort((tokens, freq, rec))
    tokens, freq = tokens[order], freq[order]  # rec is the same after sorting
    kind = 1 + (freq > SINGLE).astype(np.int64) + (freq > math.sqrt(SINGLE * max(1, classes)))
    out_rec, out_sig, out_small = [], [], []
    for band in bands:
        own = (sizes >= band.low) & (sizes < band.high)
        guest = (sizes >= band.high) & (at_least(threshold, sizes) < band.high)
        use = (own | guest)[rec]
        if not use.any():
            continue
        r, t, k = rec[use], tokens[use], kind[use]
        k = np.minimum(k, 3 if band.triples else 2 if band.pairs else 1)
        h = mix(t + np.uint64(band.number + 1)) >> np.uint64(16)
        group = np.where(k == 3, band.pairs + (h % np.uint64(max(1, band.triples))).astype(np.int64), (h % np.uint64(max(1, band.pairs))).astype(np.int64))
        # rank of each token within its record's group
        rank = np.zeros(len(t), np.int64)
        many = np.flatnonzero(k > 1)
        cell = r[many] * (band.pairs + band.triples + 1) + group[many]
        by_cell = np.argsort(cell, kind="stable")
        many, cell = many[by_cell], cell[by_cell]
        new = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
        first = np.maximum.accumulate(np.where(new, np.arange(len(cell)), 0)) if len(cell) else cell
        rank[many] = np.arange(len(cell)) - first
        worth = (rank >= k - 1).astype(np.int64)
        upto = np.cumsum(worth) - worth
        begin = np.r_[True, r[1:] != r[:-1]]
        starts = np.maximum.accumulate(np.where(begin, np.arange(len(r)), 0))
        before = upto - upto[starts]
        n = sizes[r]
        long = before < n - at_least(threshold, n) + band.need
        short = (before < n - at_least(2 * threshold / (1 + threshold), n) + band.need) & own[r]
        salt = np.uint64(0xA5A5 + band.number)
        one = np.flatnonzero(long & (k == 1))
        out_rec.append(r[one])
        out_sig.append(mix(t[one] + salt))
        out_small.append(short[one])
        keep = long[many]
        at, cell = many[keep], cell[keep]
        kk, tt, ss, rr = k[at], t[at], short[at], r[at]
        width = 1
        while width < len(at):
            same = cell[width:] == cell[:-width]
            if not same.any():
                break
            i = np.flatnonzero(same)
            j = i + width
            two = kk[i] == 2
            a, b = i[two], j[two]
            out_rec.append(rr[a])
            out_sig.append(mix(mix(tt[a] + salt) + tt[b]))
            out_small.append(ss[b])
            a, c = i[~two], j[~two]
            for inner in range(1, width):  # the third token lies between
                b = a + inner
                out_rec.append(rr[a])
                out_sig.append(mix(mix(mix(tt[a] + salt) + tt[b]) + tt[c]))
                out_small.append(ss[c])
            width += 1
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(out_rec, np.int64), cat(out_sig, np.uint64), cat(out_small, bool)


def _exactly(i: int, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Chance of i hits in n trials."""
    ways = np.prod([(n - j) / (j + 1) for j in range(i)], axis=0) if i else 1.0
    return ways * p**i * (1 - p) ** (n - i)


@lru_cache
def _least_chances() -> tuple[np.ndarray, np.ndarray]:
    """Numbers of signatures, falling, and the chance to agree on one with which so many miss a pair with MISS at most."""
    numbers = np.arange(MOST, SIGNATURES - 1, -GROUP)
    low, high = np.zeros(len(numbers)), np.ones(len(numbers))
    for _ in range(60):
        p = (low + high) / 2
        missed = sum(_exactly(i, numbers, p) for i in range(SHARED))
        low, high = np.where(missed > MISS, p, low), np.where(missed > MISS, high, p)
    return numbers, high


def agreement(tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray, records: int, threshold: float) -> np.ndarray:
    """For each record, the least chance that a partner at the threshold or above agrees on a dealt signature.

    The worst partner shares the record's most frequent tokens and lacks the rest: its combinations are the longest.
    A combination is drawn token by token from those, the next with a chance of (c - i) / (u - i) to be shared, c of
    the union's u tokens being shared; its length follows from the tokens' log shares, rounded down to CELLS steps
    (lengths are not underrated). A group that runs out agrees more often than that.
    """
    m = len(sizes)
    rec = np.repeat(np.arange(m), sizes)
    limit = -math.log(RARE / max(1, records))
    if limit <= 0:
        return np.full(m, threshold)
    weight = np.clip(-np.log(np.maximum(1, counts[_bucket(tokens)]) / max(1, records)), 0, limit)
    shared = at_least(threshold, sizes)
    weight = weight[np.argsort(rec + weight / (limit * 1.001))]  # each record's frequent tokens first; rec is the same after sorting
    rank = np.arange(len(rec)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    top = rank < shared[rec]
    cell = np.floor(weight[top] / limit * CELLS + 1e-9).astype(np.int64)
    draw = np.bincount(rec[top] * (CELLS + 1) + cell, minlength=m * (CELLS + 1)).reshape(m, CELLS + 1) / np.maximum(1, shared)[:, None]
    wave = np.fft.rfft(draw, 2 * CELLS, axis=1)
    at, out, alive, agree = np.zeros((m, CELLS)), np.zeros(m), np.ones(m), np.ones(m)
    at[:, 0] = 1
    for i in range(int(shared.max(initial=0))):
        agree = agree * np.maximum(0, shared - i) / np.maximum(1e-9, shared / threshold - i)
        at = np.maximum(0, np.fft.irfft(np.fft.rfft(at, 2 * CELLS, axis=1) * wave, 2 * CELLS, axis=1)[:, :CELLS])
        left = np.minimum(alive, at.sum(axis=1))
        out += (alive - left) * agree
        alive = left
        if (alive * agree).max(initial=0) < 1e-4:
            break
    return out


def wanted_signatures(tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray, records: int, threshold: float):
    """(signatures, sure): how many dealt signatures each record gets, and whether it is also indexed by the exact scheme.

    agreement() bounds from below the chance of every pair that a record is in, so the smaller number of a pair is
    enough for it unless both records would need more than MOST.
    """
    numbers, least = _least_chances()
    chance = agreement(tokens, sizes, counts, records, threshold)
    # least rises as the numbers fall: the last that is still reached
    place = np.searchsorted(least, chance, "right") - 1
    return numbers[np.maximum(0, place)], (place < 0) | (at_least(threshold, sizes) < LARGE)


def dealt_signatures(tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray, records: int, threshold: float, wanted: np.ndarray | None = None):
    """(record, signature, own) of records whose token sets are laid end to end; at most some thousand records.

    The number of groups depends on a band of sizes, [4^b, 4^(b+1)); a pair is looked for in the band of its smaller
    record (own), so a record that may have a partner in the band below stands there too (as a guest). There are no
    bands below LARGE. wanted: signatures of each record.
    """
    if wanted is None:
        wanted = wanted_signatures(tokens, sizes, counts, records, threshold)[0]
    rec = np.repeat(np.arange(len(sizes)), sizes)
    log_share = np.log(np.maximum(1, counts[_bucket(tokens)]) / max(1, records))
    limit = math.log(RARE / max(1, records))
    band = np.zeros(len(sizes), np.int64)
    for b in range(1, 31):
        band += sizes >= 4**b
    out = []
    for b in np.unique(band).tolist():
        for number, use in ((b, band == b), (b - 1, (band == b) & (at_least(threshold, sizes) < 4**b))):
            if number < 0 or 4**number < LARGE or not use.any():
                continue
            groups = max(1, 4**number // GROUP)
            mine = use[rec]
            r, t, share = rec[mine], tokens[mine], log_share[mine]
            turns = -(-wanted // groups)
            for turn in range(int(turns[use].max())):
                if turn >= turns[use].min():
                    more = turns[r] > turn
                    r, t, share = r[more], t[more], share[more]
                h = mix(t + np.uint64(0x9E37 + (turn << 8) + number))
                cell = (r * groups).astype(np.uint64) + (h >> np.uint64(40)) % np.uint64(groups)
                shift = max(1, int(len(sizes) * groups).bit_length())
                order = np.argsort((cell << np.uint64(64 - shift)) | (mix(h) >> np.uint64(shift)))
                c, tt, ss = cell[order], t[order], share[order]
                start = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
                end = np.append(start[1:], len(c))
                sig = mix((c[start] % np.uint64(groups)) + np.uint64((turn << 32) + (number << 24)))
                seen, live, step = np.zeros(len(start)), np.arange(len(start)), 0
                while len(live):
                    at = start[live] + step
                    there = at < end[live]
                    spent = live[~there]
                    sig[spent] = mix(sig[spent] + np.uint64(0xE0D))
                    live, at = live[there], at[there]
                    sig[live] = mix(sig[live] + tt[at])
                    seen[live] += ss[at]
                    live = live[seen[live] > limit]
                    step += 1
                out.append((r[order][start], sig, np.full(len(start), number == b)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _index(tokens: np.ndarray, sizes: np.ndarray, counts: np.ndarray, classes: int, threshold: float, bands: list[Scheme], exact: bool):
    """(record, signature, role); role: size, whether the signature is of the exact scheme, and whether it serves the pair's smaller record."""
    if exact:
        rec, sig, small = signatures(tokens, sizes, counts, classes, threshold, bands)
        return rec, sig, sizes[rec] * 4 + 2 + small
    wanted, sure = wanted_signatures(tokens, sizes, counts, classes, threshold)
    rec, sig, small = dealt_signatures(tokens, sizes, counts, classes, threshold, wanted)
    role = sizes[rec] * 4 + small
    if sure.any():
        which = np.flatnonzero(sure)
        r, g, small = signatures(tokens[np.repeat(sure, sizes)], sizes[which], counts, classes, threshold, bands)
        rec, sig, role = np.concatenate((rec, which[r])), np.concatenate((sig, g)), np.concatenate((role, sizes[which[r]] * 4 + 2 + small))
    return rec, sig, role


def _emit(k: int, counts, classes: int, threshold: float, bands: list[Scheme], exact: bool):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                sets = [_tokens(hasher, x, k) for x in batch.column(1).slice(start, 1000).to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                ids = batch.column(0).slice(start, 1000).to_numpy()
                # size and role in one number: fewer bytes to move
                rec, sig, role = _index(np.concatenate(sets), sizes, counts.value, classes, threshold, bands, exact)
                role = role.astype(np.int32)
                by_record = np.argsort(rec, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(sig[by_record].view(np.int64)), pa.array(ids[rec][by_record]), pa.array(role[by_record])], names=["sig", "id", "role"])

    return run


def pack(tokens: np.ndarray) -> bytes:
    """Sorted tokens, whole: 64 bits each."""
    return tokens.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _pack_sets(k: int):
    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                sets = [pack(_tokens(hasher, x, k)) for x in batch.column(1).slice(start, 2000).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 2000), pa.array(sets, pa.binary())], names=["id", "tokens"])

    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            shared = np.array([np.intersect1d(unpack(x), unpack(y), assume_unique=True).size for x, y in zip(a, b, strict=True)], np.int64)
            both = np.array([(len(x) + len(y)) // 8 for x, y in zip(a, b, strict=True)], np.int64) - shared
            ok = pa.array(shared >= threshold * both - 1e-9)
            out = [batch.column(0), batch.column(1), pa.array(shared / np.maximum(1, both), pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "similarity"]).filter(ok)

    return run


class NearDuplicates:
    """The result of a join: classes of equal records, and links between classes."""

    def __init__(self, members: DataFrame, links: DataFrame):
        #: (id, class_id, n): each record's class, named by its smallest id, and the size of its set.
        self.members = members
        #: (a, b, similarity): classes a < b whose similarity reaches the threshold.
        self.links = links

    def pairs(self) -> DataFrame:
        """(a, b) of different records, a < b, copies included: as many rows as there are pairs."""
        m = self.members.filter("n > 0").select("id", "class_id")
        x, y = m.withColumnsRenamed({"id": "i", "class_id": "a"}), m.withColumnsRenamed({"id": "j", "class_id": "b"})
        copies = self.members.filter("n > 0").groupBy("class_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("class_id")
        own = m.join(copies, "class_id", "left_semi")
        same = own.withColumnRenamed("id", "a").join(own.withColumnRenamed("id", "b"), "class_id").filter("a < b").select("a", "b")
        far = self.links.select("a", "b").join(x, "a").join(y, "b").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        return same.unionByName(far)

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, links): for each record its group, the records connected by links, named by the smallest class.

        links counts the records that are near duplicates of it, copies included.
        """
        sizes = self.members.groupBy("class_id").agg(F.count(F.lit(1)).alias("m"))
        both = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy("a").agg(F.sum("m").alias("far"))
        named = components(self.links)
        per_class = sizes.join(degree.withColumnRenamed("a", "class_id"), "class_id", "left").join(named.withColumnRenamed("id", "class_id"), "class_id", "left")
        per_class = per_class.select("class_id", F.coalesce("component", "class_id").alias("group_id"), (F.coalesce("far", F.lit(0)) + F.col("m") - 1).alias("links"))
        empty = F.col("n") == 0
        out = self.members.join(per_class, "class_id")
        return out.select("id", F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("id")).otherwise(F.col("group_id")).alias("group_id"), F.when(empty, F.lit(0).cast("long")).otherwise(F.col("links")).alias("links"))


def near_duplicates(df: DataFrame, id_col: str, text: Column, k: int = 5, threshold: float = 0.8, exact: bool = False) -> NearDuplicates:
    """Records of df whose sets of runs of k words have a Jaccard similarity of at least the threshold.

    exact: see above. Nulls count as empty text. A record with fewer than k words has no set and is like nothing; repeated ids are not
    expected (each is taken as a record). Text is used whole. An empty df has no members and links.
    """
    spark = df.sparkSession
    texts = spread(df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text")))
    rows = materialise(texts.mapInArrow(_first_pass(k), "id long, key binary, n int"))
    classes = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("class_id"))
    members = materialise(rows.join(classes, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "n"))
    count, low, high = members.filter("n > 0 and id = class_id").agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()
    bands = schemes(low, high, threshold) if count else []
    copies = members.filter("n = 0 or id <> class_id").select("id")
    own = small_join(texts, copies, ["id"], "left_anti", BROADCAST_IDS)
    counts = spark.sparkContext.broadcast(_sum_sketch(materialise(own.mapInArrow(_sketch(k), "block int, counts binary"))))  # 4 MB, fixed
    # One exchange serves both sides of the join: the condition on the left role also names the right one, so that it is
    # tested in the join and not pushed below the exchange, where it would make two of it.
    sigs = own.mapInArrow(_emit(k, counts, count, threshold, bands, exact), "sig long, id long, role int")
    left = sigs.select("sig", F.col("id").alias("i"), F.col("role").alias("ri"))
    right = sigs.select("sig", F.col("id").alias("j"), F.col("role").alias("rj"))
    ni, nj = F.shiftright("ri", 2), F.shiftright("rj", 2)
    role = F.col("ri").bitwiseAND(1) + F.col("rj").bitwiseAND(0) == 1
    fits = role & (ni >= F.lit(threshold) * nj - 1e-9) & ((ni < nj) | ((ni == nj) & (F.col("i") < F.col("j"))))
    found = left.join(right, "sig").filter(fits)
    need = F.lit(1)
    for b in bands:
        need = F.when(ni >= b.low, F.lit(b.need)).otherwise(need)
    sure = F.col("ri").bitwiseAND(2) > 0
    # one kind of signature is enough for a pair
    pairs = found.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), need.alias("need"), sure.alias("sure"))
    shared = pairs.groupBy("a", "b").agg(*[F.sum(F.when(F.col("sure") == x, 1).otherwise(0)).alias(c) for c, x in (("by_exact", True), ("by_dealt", False))], F.max(F.when(F.col("sure"), F.col("need"))).alias("need"))
    shared = shared.filter((F.col("by_exact") >= F.col("need")) | (F.col("by_dealt") >= SHARED))
    candidates = materialise(shared.select("a", "b"))
    involved = candidates.select(F.col("a").alias("id")).unionByName(candidates.select(F.col("b").alias("id"))).distinct()
    sets = materialise(small_join(texts, involved, ["id"], "left_semi", BROADCAST_IDS).mapInArrow(_pack_sets(k), "id long, tokens binary"))
    both = candidates.join(sets.withColumnsRenamed({"id": "a", "tokens": "ta"}), "a").join(sets.withColumnsRenamed({"id": "b", "tokens": "tb"}), "b")
    links = materialise(both.select("a", "b", "ta", "tb").mapInArrow(_verify(threshold), "a long, b long, similarity double"))
    return NearDuplicates(members, links)
