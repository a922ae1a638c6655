"""Near-duplicates against brute force, with families of copies, shared passages and edge rows."""

import random
import re

import pytest

from tessera.llm import near_dup
from tessera.llm.shared import components


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: find(i) for i in ids}, {i: [len(s) for s in v] for i, v in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(lexicon) for _ in range(n)]
    passage = text(60)
    docs = [text(rng.randint(1, 120)) for _ in range(40)]
    for base in [text(n) for n in (4, 8, 30, 70, 150, 400)]:  # families of changing distance
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(lexicon)
            docs.append(copy)
    docs += [passage + text(rng.randint(3, 60)) for _ in range(40)]  # a passage that many share
    chain = text(100)
    for _ in range(15):  # linked only one by one
        docs.append(list(chain))
        chain[rng.randrange(100)] = rng.choice(lexicon)
        chain[rng.randrange(100)] = rng.choice(lexicon)
    docs += [docs[5]] * 30
    rng.shuffle(docs)
    return [(i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.2 else w for w in d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, words, percent):
    rows = corpus(words) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (3, "again here under a used id"), (None, "one"), (906, "Élan vital x"), (907, "élan vital x"),
                            (908, "z " * 300_000)]
    want, sizes = brute(rows, words, percent)
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, n int, id int").repartition(6)
    out = near_dup.near_duplicates(spark, docs, words=words, percent=percent).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id) and r.n_shingles in sizes[r.doc_id]
    assert near_dup.near_duplicates(spark, docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, k) for k in range(501, 600)] + [(599, 700), (800, 800)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 600), 500), 700: 500}


def test_long_lists_of_texts_that_share_too_little_form_no_pairs(spark):
    """12,000 texts with 200 of 220 shingles in common (similarity 0.83): all pairs of their lists would be 2 * 10 ** 9."""
    from pyspark.sql import functions as F

    shared = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: i.cast("long"))
    family = spark.range(12_000).select("id", F.lit(220).cast("long").alias("n"), F.col("id").alias("component"), shared.alias("shingles"))
    near = spark.createDataFrame([(20_000, 203, 20_000), (20_001, 216, 20_001)], "id long, n long, component long").withColumn("shingles", shared)
    got = near_dup._open_pairs(spark, family.union(near), 85).collect()
    # 203 and 216 with 200 in common: 0.913; 203 and 220: 0.897; 216 and 220: 0.847, no link
    assert sorted((r.a, r.b) for r in got) == sorted([(20_000, 20_001)] + [(i, 20_000) for i in range(12_000)])
