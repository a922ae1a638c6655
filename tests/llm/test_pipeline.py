"""The pipeline stage by stage against brute force on its own input, and as a whole."""

import random

import corpus_pipeline as C
from tessera.llm import decontaminate, pseudonyms
from tests.llm.test_decontaminate import words_of
from tests.llm.test_near_dup import brute


def tables(spark, tmp_path):
    rng = random.Random(4)
    lexicon = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "ve", "di") for c in ("r", "n", "s", "", "l")]
    text = lambda n: " ".join(rng.choice(lexicon) for _ in range(n)) + "."
    bench = [(i, text(30)) for i in range(6)]
    good = [text(rng.randint(30, 150)) for _ in range(120)]
    junk = [" ".join(rng.choice(lexicon).upper() + rng.choice(["###", "$$$", "!!"]) for _ in range(80)) for _ in range(60)]
    near = [t.replace(t.split()[3], "changed", 1) for t in good[:20]] + good[20:40]
    leaks = [f"{good[50]} {b} end of {i}." for i, (_, b) in enumerate(bench)]
    private = [f"{text(40)} mail me.{i}@site{i}.org or +1 (988) 555-24{i:02d}" for i in range(10)]
    texts = good + junk + near + leaks + private + [None, "", good[0]]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, text(60), "en", "s", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120)) for i in range(180)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, junk, bench


def test_stages(spark, tmp_path):
    d, rows, junk, bench = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES:
        out = stage(spark, docs, d)
        if name != "encode":
            assert out.columns == docs.columns, name
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.asDict().get("text") for r in docs.collect()}
        assert after.keys() <= before.keys()
        if name == "quality":
            assert not set(junk) & set(after.values())
            assert len(after) >= 0.97 * (len(before) - len(junk))
        if name == "near_dup":
            root, _ = brute(list(before.items()), 5, 80)
            assert after.keys() == {i for i in before if i is None or root[i] == i}
        if name == "decontaminate":
            leaked = {i for i, t in before.items() for _, b in bench if " ".join(words_of(b)) in " ".join(words_of(t))}
            assert leaked and after.keys() == before.keys() - leaked
        if name == "pseudonyms":
            assert after == {i: t if t is None else pseudonyms.replace(t, C.EXAMPLE_KEY)[0] for i, t in before.items()}
            assert any(after[i] != before[i] for i in after)
        if name == "encode":
            assert after.keys() == before.keys()
        before = after
    whole = C.run(spark, d)
    assert whole.columns == docs.columns
    assert sorted((r.ids_sha256, r.n_tokens) for r in whole.collect()) == sorted((r.ids_sha256, r.n_tokens) for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    d, *_ = tables(spark, tmp_path / "full")
    e = str(tmp_path / "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{e}/{t}.parquet")
    assert C.run(spark, e).count() == 0
