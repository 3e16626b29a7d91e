"""The index of tokens against a plain search of every word in every text."""

import random

import numpy as np

from storyloom.operators import holding as module
from storyloom.operators.holding import WINDOW, holding, meeting


def test_against_every_pair(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(3 * WINDOW))
    texts = {1: "The cat sat\ton the mat", 2: "민수가 기차역에서 보았다", 3: long, 4: "", 5: None, 6: "a.b (cat) a.b", 7: "mat on the\ncat"}
    words = ["cat", "at", "기차역", "the mat", "a.b", "aXb", "missing", "", "  ", long[WINDOW - 20 : WINDOW + 30], long[:2], "on the\ncat", None, "cat"]
    got = holding(spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()
    want = {(i, w) for i, t in texts.items() for w in words if t and w and w.strip() and w in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty(spark):
    none, some = spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "x")], "id long, text string")
    assert holding(none, spark.createDataFrame([("x",)], "word string")).count() == 0
    assert holding(some, spark.createDataFrame([], "word string")).count() == 0


def test_meeting_in_small_slices_equals_every_pair(spark):
    def all_pairs(held, sets):
        hits = [held[rows].sum(axis=0) for rows in sets]
        i = np.repeat(np.arange(len(sets)), held.shape[1])
        return i, np.tile(np.arange(held.shape[1]), len(sets)), np.concatenate(hits), np.zeros(len(i), dtype=np.int64)

    r = random.Random(4)
    text = lambda n: "".join(r.choice("ab 민") for _ in range(n))
    texts = [(r.choice(["x", "y"]), i, None if i % 17 == 0 else text(r.randrange(60))) for i in range(80)] + [("alone", 900, "ab"), (None, 901, "ab")]
    sets = [(r.choice(["x", "y"]), i, [text(r.randint(0, 3)) for _ in range(4)] + ["ab", "ab", None, ""] + [t[5:28] for _, _, t in texts if t and len(t) > 50 and t[5:28].strip()][:2]) for i in range(30)] + [("none", 800, ["ab"]), ("x", 801, None), ("x", 802, [" ", None])]
    t, s = spark.createDataFrame(texts, "case string, id long, text string"), spark.createDataFrame(sets, "case string, set long, words array<string>")
    want = {(k, i): sum(w in (x or "") for w in words if w and w.strip()) for c, k, words in sets if words and any(w and w.strip() for w in words) for d, i, x in texts if c == d}
    for size, most, cells in ((1 << 20, 256, 1 << 20), (200, 7, 1 << 20), (200, 7, 100)):
        got = meeting(t, s, all_pairs, size=size, most=most, cells=cells).collect()
        assert len(got) == len(want) and {(x.set, x.id): x.score for x in got} == want
    assert max(want.values()) > 4


def test_table_of_words_and_texts_across_steps(monkeypatch):
    r = random.Random(5)
    for _ in range(200):
        monkeypatch.setattr(module, "SLICE", r.choice([1, 7, 20, 100]))
        signs = r.choice([b"ab", b"a\x00\xff b"])
        texts = [None if r.random() < 0.1 else bytes(r.choices(signs, k=r.randrange(40))) for _ in range(r.randint(1, 8))]
        words = list({bytes(r.choices(signs, k=r.randint(1, r.choice([3, 12, 30])))) for _ in range(9)} | {t[2:25] for t in texts if t and len(t) > 3})
        assert (module._held(texts, words) == np.array([[w in (t or b"") for t in texts] for w in words])).all()
