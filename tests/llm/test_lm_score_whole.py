"""The language model's weights come from all training rows."""

import numpy as np

from tessera.llm import lm_score as L
from tessera.llm import sentencepiece_bpe as SP
from tessera.llm.queries import vocabulary


def test_all_training_rows_move_the_weights(spark, monkeypatch):
    model = vocabulary("piece_bpe_32k.model")
    rows = [(7, "a b c d")] * 2500 + [(100 + i, f"one{i % 7} two three") for i in range(1500)] + [(None, "zebra quartz " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    start = L.Attention(len(SP._encoder(model, False).pieces.kinds)).w["embed"]
    nets, fitted = [], L.fitted
    monkeypatch.setattr(L, "fitted", lambda *a, **k: nets.append(fitted(*a, **k)) or nets[-1])
    two = [sorted((r.doc_id or 0, r.score) for r in L.lm_scores(spark, docs, model, epochs=1, fold=0, fold_of=10**6).collect()) for _ in range(2)]
    assert two[0] == two[1] and all(np.array_equal(nets[0].w[k], nets[1].w[k]) for k in nets[0].w)
    moved = np.flatnonzero((nets[0].w["embed"] != start).any(axis=1))
    shared = spark.sparkContext.broadcast(model)
    counts = L.piece_counts(docs.select("text"), shared, len(start))
    pieces = SP._encoder(model, False).pieces
    assert set(np.flatnonzero(counts)) - {pieces.eos} <= set(moved)  # also what only the last stretch, or a row without id, has
