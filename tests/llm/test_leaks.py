import random

import numpy as np
from hypothesis import given, settings, strategies as st

from packetflow.llm import leaks as L
from packetflow.llm.words import Hasher, words

DOCS = "doc_id bigint, text string, item_id string, passage string"
ITEMS = "item_id int, passage string, text string"


def sentence(rng, n=12):
    return " ".join("".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)).capitalize() + "."


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    return sorted((r.doc_id, r.item_id) for r in L.found_leaks(d, spark.createDataFrame([(i, p, "z") for i, p in items], ITEMS)).collect())


def test_leaks(spark):
    rng = random.Random(7)
    std = sentence(rng)
    own = {i: [sentence(rng) for _ in range(6)] for i in range(1, 7)}
    items = [(i, " ".join([std, *own[i]])) for i in own] + [(7, None), (8, ""), (9, std)]
    fill = lambda: " ".join(sentence(rng) for _ in range(8))
    noisy = own[3][1].replace("o", "0").upper()
    altered = [own[5][k].split() for k in range(4)]
    for a in altered:
        a[4] = "other"
        a.insert(9, "indeed")
    docs = [
        (1, fill() + " " + items[0][1]), (2, fill() + own[2][3] + " " + fill() + own[2][1] + fill()), (3, f"{noisy}\n{own[3][0]} {fill()}"), (4, fill() + own[4][0]), (5, " ".join(" ".join(a) for a in altered)),
        (6, std + " " + fill()), (7, None), (8, ""), (9, fill()), (10, "word " * 200_000 + " ".join(own[6])), (11, items[0][1]),
    ]
    assert found(spark, docs + docs[:1], items) == [(1, 1), (2, 2), (3, 3), (5, 5), (10, 6), (11, 1)]


def test_empty(spark):
    assert found(spark, [(1, "a b c")], []) == [] and found(spark, [], [(1, "a b c d e f g h")]) == []


def brute(p, t, least):
    free_p, free_t, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and free_p[i + n] and free_t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append((i, j, n))
        for k in range(n):
            free_p[i + k] = free_t[j + k] = False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=18))
def test_tiles_cover_as_brute_force(p, t):
    a, b = np.array(p, np.uint64), np.array(t, np.uint64)
    seeds = [(i, j) for i in range(len(p) - 1) for j in range(len(t) - 1) if p[i : i + 2] == t[j : j + 2]]
    got, right = L.tiles(a, b, seeds, 2), brute(p, t, 2)
    assert sorted(n for _, _, n in got) == sorted(n for *_, n in right) or sum(n for *_, n in got) >= 0.7 * sum(n for *_, n in right)
    spots = [x for i, _, n in got for x in range(i, i + n)]
    assert len(spots) == len(set(spots)) and all(p[i + k] == t[j + k] for i, j, n in got for k in range(n))


def test_windows_and_folding():
    h = Hasher()
    a, b = h.codes(words("The Quick brown fox jumps")), h.codes(words("the qu1ck bröwn f0x jumps"))
    assert (a == b).all() and len(h.windows(a, 4)) == 2 and len(h.windows(a[:3], 4)) == 0
    assert h.windows(a, 4)[1] == h.windows(a[1:], 4)[0]


def corpus(rng, n):
    return [(1000 + i, " ".join(sentence(rng) for _ in range(3))) for i in range(n)]


def test_copies_and_frequent_leaks_are_no_standard_sentences(spark):
    rng = random.Random(11)
    passage = " ".join(sentence(rng) for _ in range(5))
    copies = [(i, "Fwd: " + passage) for i in range(40)]
    frequent = [(100 + i, f"{sentence(rng)} {passage} {sentence(rng)}") for i in range(30)]
    assert found(spark, copies + corpus(rng, 60), [(1, passage)]) == [(i, 1) for i, _ in copies]
    assert found(spark, frequent + corpus(rng, 60), [(1, passage)]) == [(i, 1) for i, _ in frequent]


def test_short_quotation_of_many_texts_is_standard(spark):
    rng = random.Random(12)
    own = [sentence(rng) for _ in range(8)]
    quoting = [(i, f"{sentence(rng)} {own[0]} {sentence(rng)}") for i in range(30)]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in [*quoting, (99, " ".join(own[:3]))]], DOCS)
    assert [(r.doc_id, round(r.coverage, 2)) for r in L.leaks(d, spark.createDataFrame([(1, " ".join(own), "z")], ITEMS)).collect()] == [(99, round(2 / 7, 2))]


def test_repeated_items_are_one_passage(spark):
    rng = random.Random(13)
    a, b = (" ".join(sentence(rng) for _ in range(5)) for _ in range(2))
    docs = [(1, f"{sentence(rng)} {a}"), (2, b)]
    assert found(spark, docs, [(1, a)] * 4 + [(i, b) for i in (2, 3, 4, 5)]) == [(1, 1), (2, 2), (2, 3), (2, 4), (2, 5)]


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(14)
    std = " ".join(sentence(rng) for _ in range(2))
    items = [(i, " ".join([std, *(sentence(rng) for _ in range(4))])) for i in range(1, 5)]
    docs = [(1, std), (2, items[2][1]), (3, sentence(rng))]
    whole = found(spark, docs, items)
    monkeypatch.setattr(L, "BLOCK_ITEMS", 2)
    assert found(spark, docs, items) == whole == [(2, 3)]
