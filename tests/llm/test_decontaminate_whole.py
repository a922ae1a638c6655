"""Decontamination: weights of the whole benchmark, whatever its blocks and repeats."""

import random

import numpy as np

from tessera.llm import decontaminate as D


def found(spark, docs, bench, **kw):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words, r.distance) for r in D.contaminated(spark, d, b, **kw).collect()}


def changed(rng, words, n=1):
    w = list(words)
    for i in rng.sample(range(5, len(w) - 5), n):
        w[i] = f"new{rng.randrange(10**9)}"
    return w


def test_weights_are_the_same_in_all_blocks(spark):
    rng = random.Random(4)
    word = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    frame = word(30)
    items = [frame + word(30) for _ in range(12)] + [word(50) for _ in range(12)]
    bench = [" ".join(x) for x in items]
    docs = [" ".join(word(9) + changed(rng, x) + word(9)) for x in items for _ in range(3)]
    whole = found(spark, docs, bench)
    assert whole
    for size in (400, 1500):
        assert found(spark, docs, bench, block_bytes=size) == whole


def test_repeating_an_item_changes_nothing(spark):
    rng = random.Random(5)
    item = [f"w{i}" for i in range(60)]
    doc = " ".join([*item[:30], "other", *item[31:]])
    once = found(spark, [doc], [" ".join(item)])
    assert abs(once[0, 0][0] - 51 / 61) < 1e-9
    for bench in ([" ".join(item)] * 2, [" ".join(item), ", ".join(item).upper()], [" ".join(item)] * 40):
        assert found(spark, [doc], bench) == {(0, i): once[0, 0] for i in range(len(bench))}
        assert found(spark, [doc], bench, block_bytes=300) == {(0, i): once[0, 0] for i in range(len(bench))}


def test_radius_keeps_similar_windows():
    rng = np.random.default_rng(6)
    items, edited = [], []
    for _ in range(6000):
        h = rng.integers(0, 1 << 63, 55).astype(np.uint64)
        items.append(D.fingerprints(D.signs(h[:45]), np.array([0]), 45)[0])  # 40 shingles stay, 5 go, 5 come: similarity 0.8
        edited.append(D.fingerprints(D.signs(np.concatenate([h[:40], h[45:50]])), np.array([0]), 45)[0])
    far = np.bitwise_count(np.array(items) ^ np.array(edited))
    assert (far > 15).any() and (far > D.RADIUS).sum() == 0


def test_all_similar_windows_are_found(spark):
    rng = random.Random(7)
    items = [[f"w{rng.randrange(3000)}" for _ in range(49)] for _ in range(40)]
    docs = [" ".join(["before", *changed(rng, x), "after"]) for x in items for _ in range(50)]
    got = found(spark, docs, [" ".join(x) for x in items])
    assert {(i, i // 50) for i in range(len(docs))} <= got.keys()


def test_texts_shorter_than_an_item(spark):
    rng = random.Random(8)
    items = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (60, 60, 200, 6000, 20, 4)]
    docs, want = [], {}
    for i, x in enumerate(items):
        for part in (x[:-1], x[1:], x[1:-1], x[: len(x) * 9 // 10], x[: len(x) // 2], x[: len(x) // 2] + x[len(x) // 2 + 1 :], x[:4]):
            size, k = len(x) - min(5, len(x)) + 1, min(5, len(x))
            known = {tuple(x[a : a + k]) for a in range(size)}
            own = [tuple(part[a : a + k]) for a in range(len(part) - k + 1)]
            both = sum(s in known for s in own)
            if both and both / (size + len(own) - both) >= 0.8:
                want[len(docs), i] = (both / (size + len(own) - both), 0, len(part))
            docs.append(" ".join(part))
    got = found(spark, docs, [" ".join(x) for x in items])
    assert (0, 0) in want and (want[0, 0][0] - 55 / 56) < 1e-9
    assert got.keys() == want.keys()
    assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1:3] == want[p][1:] for p in want)
