import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodepath.llm import leakage as L
from lodepath.llm.words import WORD, visible


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index(seq, phrase):
    index = L.FMIndex(np.array(seq, np.int64), 6)
    low, high = index.search(np.array([phrase]))
    found = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
    assert found == [i for i in range(len(seq) - len(phrase) + 1) if seq[i : i + len(phrase)] == phrase]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(seq):
    assert L.suffix_array(np.array(seq, np.int64)).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


def corpus(seed=1):
    r = random.Random(seed)
    ws = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(ws, k=r.choice([5, 13, 14, 30])))) for i in range(40)] + [(40, None), (41, "")]
    items += [(50, items[3][1]), (51, items[7][1].upper() + " Straße STRASSE")]
    docs = []
    for d in range(120):
        text = r.choices(ws + ["odd"], k=r.choice([0, 5, 40]))
        if d % 2:
            part = (items[r.randrange(40)][1]).split()
            a = r.randrange(len(part))
            text += part[a : a + r.choice([12, 13, 20])]
            text += r.choices(ws, k=5)
        glue = r.choice([" ", ", ", "<br>", "&nbsp;", "​ ­"])
        docs.append((d, glue.join(t.title() if r.random() < 0.3 else t for t in text)))
    return [*docs, (200, None), (201, ""), (202, "odd " * 5000 + items[3][1]), (203, items[3][1] + " x " + items[3][1])], items


def brute(docs, items, k=13):
    ws = lambda t: WORD.findall(visible(t).casefold())
    own = {}
    for i, t in items:
        w = ws(t)
        for a in range(len(w) - k + 1):
            own.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = {}
    for d, t in docs:
        w = ws(t)
        for a in range(len(w) - k + 1):
            for i in own.get(tuple(w[a : a + k]), ()):
                out.setdefault((d, i), set()).update(range(a, a + k))
    return out


@pytest.mark.parametrize(("words", "size"), [(L.SHARD_WORDS, L.ITEM_BYTES), (40, 300)])
def test_leaks(spark, monkeypatch, words, size):
    docs, items = corpus()
    monkeypatch.setattr(L, "SHARD_WORDS", words)
    monkeypatch.setattr(L, "ITEM_BYTES", size)
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = {}
    for r in L.leaks(d, "doc_id", "text", i, "item_id", "text").collect():
        got.setdefault((r.id, r.item_id), set()).update(range(r.first_word, r.end_word))
    assert got == brute(docs, items)
    assert L.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0 and L.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
