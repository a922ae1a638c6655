"""Decontamination: brute force over all windows, the radius guarantee of the index, edge rows."""

import random
import re
from collections import Counter

import numpy as np

from tessera.llm import decontaminate as D


def words_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_index_finds_all_within_the_radius():
    r = np.random.default_rng(3)
    items = r.integers(0, 1 << 63, 60).astype(np.uint64)
    group = r.integers(0, 3, 60)
    queries = np.concatenate([items ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (n, 60)).astype(np.uint64), axis=0) for n in (1, 8, 14, 15, 17, 25)])
    groups = r.integers(0, 3, len(queries))
    index = D.HammingIndex(items, group, 3, D.RADIUS)
    got = set(zip(*(x.tolist() for x in index.search(queries, groups))))
    want = {(q, i, int(d)) for q in range(len(queries)) for i in range(60) if groups[q] == group[i] and (d := np.bitwise_count(queries[q] ^ items[i])) <= D.RADIUS}
    assert got == want


def test_equals_brute_force(spark):
    rng = random.Random(2)
    lexicon = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [text(rng.randint(5, 60)) for _ in range(25)] + [text(3), text(1), [], text(400)]
    items.append(list(items[0]))
    docs = [text(rng.randint(0, 200)) for _ in range(30)]
    for item in items:
        for edits in (0, 0, 1, 2, 5):
            w = list(item)
            for _ in range(edits):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(lexicon)
            docs.append(text(rng.randint(0, 50)) + w + text(rng.randint(0, 50)))
    docs.append(items[1] + text(20) + items[1])
    rows = [(i, rng.choice([" ", "\n", ", "]).join(w.upper() if rng.random() < 0.3 else w for w in d), 1) for i, d in enumerate(docs)] + [(900, None, 1), (901, "", 1), (902, "...", 1)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None), (99, "")]
    of = D.Benchmark([b for b in bench if b[1] is not None], 5, D.RADIUS)
    want = {}
    of_item = {place: Counter(_shingles(item, min(5, len(item)))) for place, item in enumerate(items) if item}
    for doc, t, _ in rows:
        w = words_of(t)
        of_doc = {k: _shingles(w, k) for k in {min(5, len(item)) for item in items if item} if len(w) >= k}
        for place, other in of_item.items():
            n, k = len(items[place]), min(5, len(items[place]))
            for a in range(len(w) - n + 1):
                one = Counter(of_doc[k][a:a + n - k + 1])
                if one.keys() & other.keys() and (s := of.similarity(one, other)) >= 0.8 and s > want.get((doc, place), (0,))[0]:
                    want[doc, place] = (s, a)
    d, b = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.distance) for r in D.contaminated(spark, d, b).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in got)
    small = {(r.doc_id, r.item_id) for r in D.contaminated(spark, d, b, block_bytes=500).collect()}
    assert small == got.keys()  # blocks change nothing
    clean = D.decontaminated(spark, d, b)
    assert clean.columns == d.columns and Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if not any(p[0] == r[0] for p in got))
    often = b.union(b.where("item_id = 1").crossJoin(spark.range(500).select()))
    assert sorted(map(tuple, D.contaminated(spark, d, often).collect())) == sorted(map(tuple, D.contaminated(spark, d, b).collect()))
    assert max(len(found) for found, _ in D.benchmark_blocks(spark, often, "item_id", "text", 5, 16 << 20)) <= len(bench)
    for x, y in ((d.limit(0), b), (d, b.limit(0))):
        assert D.contaminated(spark, x, y).count() == 0
    assert D.decontaminated(spark, d, b.limit(0)).count() == len(rows)


def _shingles(words, k):
    import pyarrow as pa

    from tessera.llm import bytewords as B

    buf, offsets = B.text_bytes(pa.array([" ".join(words)]))
    hashes, at = D.word_hashes(buf, offsets)
    return B.shingles(hashes, at, k)[0].tolist()
