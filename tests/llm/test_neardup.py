import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodepath.llm import neardup as N
from lodepath.llm.words import Hasher, plain, runs, visible, words

VOCABULARY = [f"w{i}" for i in range(60)] + ["the", "and", "team"] * 8


def corpus(n=260, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.25:
            out.append(out[r.randrange(len(out))])
        elif out and kind < 0.6:
            ws = (out[r.randrange(len(out))] or "").split()
            for _ in range(r.choice([1, 2, 4, 8])):
                if ws:
                    k = r.randrange(len(ws))
                    ws[k : k + r.randint(0, 2)] = r.choices(VOCABULARY, k=r.randint(0, 2))
            out.append(" ".join(ws))
        else:
            out.append(" ".join(r.choices(VOCABULARY, k=r.choice([3, 4, 6, 10, 30, 60, 140]))))
    return [*out, None, "", "one two", "same three words", "same three words", "<b>same&nbsp;three</b> WORDS"]


def brute(texts, k, t):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (words(plain(x)) for x in texts)]
    out = set()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= t:
                out.add((j, i))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, x, 7, "c", b"k") for i, x in enumerate(texts)], "row long, text string, id int, class_id string, key binary")


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize(("k", "t"), [(3, 0.6), (5, 0.8)])
def test_pairs(spark, exact, k, t):
    texts = corpus()
    got = [tuple(r) for r in N.near_duplicates(frame(spark, texts), "row", F.col("text"), k, t, exact).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, k, t)


def test_groups(spark):
    texts = corpus()
    found = N.near_duplicates(frame(spark, texts), "row", F.col("text"), 3, 0.6)
    rows = {r.id: r for r in found.groups().collect()}
    pairs = brute(texts, 3, 0.6)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: r.group_id for i, r in rows.items()} == {i: root(i) for i in range(len(texts))}
    assert all(r.links == sum(i in p for p in pairs) for i, r in rows.items())


def test_hot_group_of_copies(spark):
    texts = ["a long enough text that stands here again and again"] * 200 + corpus(60)
    got = N.near_duplicates(frame(spark, texts), "row", F.col("text"), 3, 0.6)
    sets = {i: frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) for i, w in enumerate(words(plain(x)) for x in texts)}
    assert got.links.count() == len({frozenset((sets[a], sets[b])) for a, b in brute(texts, 3, 0.6) if sets[a] != sets[b]})
    assert got.members.filter("class_id = 0").count() == 200


def test_edited_versions_of_a_text_that_fills_a_third_of_the_rows(spark):
    r = random.Random(8)
    text = [f"c{i}" for i in range(232)]
    edited = []
    for changes in (6, 9, 12, 15, 16, 17, 18, 19):  # a changed word changes three runs of 3: J to the text from 0.85 to 0.6
        ws = list(text)
        for at in r.sample(range(0, 232, 3), changes):
            ws[at] = f"e{changes}x{at}"
        edited.append(" ".join(ws))
    others = [" ".join(f"o{r.randrange(10**6)}" for _ in range(230)) for _ in range(250)]
    texts = [" ".join(text)] * 130 + edited + others
    got = N.near_duplicates(frame(spark, texts), "row", F.col("text"), 3, 0.6)
    assert {tuple(x) for x in got.pairs().collect()} == brute(texts, 3, 0.6)


def test_texts_from_one_template(spark):
    r = random.Random(9)
    template = [f"t{i}" for i in range(180)]
    texts = [" ".join(template + [f"o{r.randrange(10**6)}" for _ in range(52)]) for _ in range(60)]
    texts += [" ".join(f"o{r.randrange(10**6)}" for _ in range(230)) for _ in range(120)]
    wanted = brute(texts, 3, 0.6)
    got = N.near_duplicates(frame(spark, texts), "row", F.col("text"), 3, 0.6)
    assert len(wanted) == 60 * 59 // 2 and {tuple(x) for x in got.pairs().collect()} == wanted


@pytest.mark.parametrize("records", [10**4, 10**6, 10**8, 10**10])
@pytest.mark.parametrize("share", [1e-3, 1e-2, 0.33])
def test_pairs_at_the_threshold_are_indexed_together_at_any_size(records, share):
    """The edited tokens are rare, the shared ones frequent."""
    r = np.random.default_rng(6)
    missed = 0
    counts = np.ones(1 << N.SKETCH_BITS, np.float64)
    for _ in range(20):
        common = np.unique(r.integers(0, 2**63, 150).astype(np.uint64))
        counts[N._bucket(common)] = share * records
        x, y = (np.unique(np.concatenate((common, r.integers(0, 2**63, 48).astype(np.uint64)))) for _ in range(2))
        sizes = np.array([len(x), len(y)])
        rec, sig, role = N._index(np.concatenate((x, y)), sizes, counts, records, 0.6, N.schemes(min(sizes), max(sizes), 0.6), False)
        both = np.intersect1d(sig[(rec == 0)], sig[(rec == 1)])
        exact = np.isin(both, sig[role & 2 > 0])
        missed += exact.sum() < N.NEED and (~exact).sum() < N.SHARED
    assert missed == 0


@pytest.mark.parametrize("exact", [False, True])
def test_empty_table(spark, exact):
    got = N.near_duplicates(frame(spark, ["x"]).limit(0), "row", F.col("text"), 3, 0.6, exact)
    assert got.pairs().count() == 0 and got.groups().count() == 0
    assert N.near_duplicates(frame(spark, [None, ""]), "row", F.col("text"), 3, 0.6, exact).groups().count() == 2


def test_exact_scheme_keeps_its_promise():
    """Any two sets within the threshold share at least the promised signatures."""
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        n = len(x)
        drop = int(r.integers(0, int(0.4 * n) + 1))
        y = np.unique(np.concatenate((x[drop:], r.integers(0, 2**63, int(r.integers(0, max(1, n // 4)))).astype(np.uint64))))
        both = len(np.intersect1d(x, y))
        if both < 0.6 * (n + len(y) - both):
            continue
        counts = r.integers(1, 3000, 1 << N.SKETCH_BITS).astype(np.uint32)
        bands = N.schemes(min(n, len(y)), max(n, len(y)), 0.6)
        with np.errstate(over="ignore"):
            rec, sig, small = N.signatures(np.concatenate((x, y)), np.array([n, len(y)]), counts, 5000, 0.6, bands)
        a, b = (0, 1) if n <= len(y) else (1, 0)
        band = next(s for s in bands if s.low <= min(n, len(y)) < s.high)
        assert len(np.intersect1d(sig[(rec == a) & small], sig[rec == b])) >= band.need


def test_dealt_signatures_depend_on_the_set_alone():
    r = np.random.default_rng(4)
    x, y = (np.unique(r.integers(0, 2**63, 90).astype(np.uint64)) for _ in range(2))
    counts = r.integers(1, 50, 1 << N.SKETCH_BITS).astype(np.uint32)
    with np.errstate(over="ignore"):
        one = N.dealt_signatures(x, np.array([len(x)]), counts, 1000, 0.6)[1]
        rec, both, _ = N.dealt_signatures(np.concatenate((y, x)), np.array([len(y), len(x)]), counts, 1000, 0.6)
    assert set(one) == set(both[rec == 1]) and len(one) >= N.SIGNATURES


def test_words_and_packing():
    assert words(plain("<p>Don&#39;t_stop</p>É2")) == ["don", "t", "stop", "é2"] and visible("a​b&shy;c") == "abc"
    h = Hasher()
    t = np.unique(runs(h("a b c d e f".split()), 3))
    assert len(t) == 4 and len(N.unpack(N.pack(t))) == 4 and (N.unpack(N.pack(t)) == t).all()
    assert len(runs(h(["a"]), 3)) == 0
