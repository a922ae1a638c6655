"""The classifier: gradients, coverage by chunks, held-out accuracy, edge rows."""

import numpy as np

from tessera.llm import quality_cnn as Q
from tests.conftest import SF


def test_chunks_cover_every_byte():
    for n in (0, 1, 64, 255, 256, 257, 448, 449, 1000, 12345):
        s = Q.chunk_starts(n)
        seen = np.zeros(max(n, 1), dtype=bool)
        for a in s:
            seen[a:a + Q.CHUNK] = True
        assert seen.all() and (len(s) == 1 or s[-1] < n)


def test_gradient():
    r = np.random.default_rng(0)
    net, chunks, first, label = Q.Network(), r.integers(32, 120, (7, Q.CHUNK)).astype(np.uint8), np.array([0, 2, 3]), np.array([1.0, 0, 1], np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        z = net.logit(net.chunk_features(net.pooled(chunks)), first)
        return float(np.mean(np.log1p(np.exp(z)) - label * z))

    g = net.gradient(chunks, first, label)
    for name, w in net.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.1')}/labels.parquet")
    rows = Q.quality_scores(spark, docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    good = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(good) > 0.99


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x", 0.5), (3, "x", 0.5), (None, "y", 0.5), (4, "### " * 200_000, 0.5), (5, "plain words here", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (4, 0), (5, 1), (5, None), (77, 0)], "doc_id long, quality int")
    rows = Q.quality_scores(spark, docs, labels, epochs=1).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert {r.score for r in Q.quality_scores(spark, docs, labels.limit(0)).collect()} == {1.0}
    assert {r.score for r in Q.quality_scores(spark, docs, labels.where("quality = 0")).collect()} == {0.0}
    assert Q.quality_scores(spark, docs.limit(0), labels, epochs=1).count() == 0


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.range(3000).selectExpr("id % 10 as doc_id", "concat('text ', id) as text")
    labels = spark.range(10).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    share, chunks, label = Q.training_rows(docs, labels, 3, 8, "doc_id", "text", "quality", 2, 4)
    assert 0 < len(chunks) == len(label) <= 6
    again = Q.training_rows(docs.repartition(7), labels, 3, 8, "doc_id", "text", "quality", 2, 4)
    assert all((a == b).all() for a, b in zip(chunks, again[1])) and label.tolist() == again[2].tolist() and share == again[0]
