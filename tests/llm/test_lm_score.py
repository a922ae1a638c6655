"""The scorer: gradients, windows, causality, exact base, held-out gain over an untrained model, edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import bytewords as B
from tessera.llm import lm_score as L
from tessera.llm import sentencepiece_bpe as SP
from tessera.llm.queries import vocabulary
from tests.conftest import SF


def test_windows_score_each_input_once():
    sizes = np.array([1, 2, 15, 16, 17, 28, 29, 32, 33, 300])
    row, start, scored = L.windows(sizes)
    for r, n in enumerate(sizes):
        seen = np.zeros(n, int)
        for a, s in zip(start[row == r], scored[row == r]):
            seen[s:a + L.WINDOW] += 1
            assert s - a in (0, L.OVERLAP)
        assert (seen == 1).all()


def _plain(net, ids, target):
    """Log-probabilities of all targets, one window and one place at a time."""
    w, G, out = net.w, net.groups, np.zeros(ids.shape)
    for i, row in enumerate(ids):
        x = w["embed"][row] + w["place"]
        for t in range(L.WINDOW):
            k, v = np.split(x[: t + 1] @ w["pair"], 2, axis=1)
            a = k @ (x[t] @ w["query"]) / math.sqrt(L.DIM)
            a = np.exp(a - a.max())
            z = np.concatenate((x[t], a @ v / a.sum())) @ w["out"] + w["bias"]
            g, m = divmod(target[i, t], G)
            for part, at in ((z[:G], g), (z[G:].reshape(G, G)[g], m)):
                out[i, t] += part[at] - part.max() - np.log(np.exp(part - part.max()).sum())
    return out


def test_gradient_and_causality():
    r = np.random.default_rng(1)
    net = L.Attention(12, 3)
    net.w = {k: r.standard_normal(v.shape) * 0.5 for k, v in net.w.items()}
    x, y = r.integers(0, 12, (4, L.WINDOW)), r.integers(0, 9, (4, L.WINDOW))
    counted = np.arange(L.WINDOW) < np.array([[L.WINDOW], [2], [9], [L.WINDOW]])
    at, weight = L.last_places(counted)
    assert weight.sum(axis=1).tolist() == [4, 2, 4, 4]
    mine = np.take_along_axis(y, at, 1)
    _, g, dx = net.gradient(x, at, mine, weight)
    g["embed"] = np.stack([np.bincount(x.ravel(), weights=dx[:, c], minlength=12) for c in range(L.DIM)], axis=1)
    for name, w in net.w.items():
        place = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        keep, got = w[place], []
        for d in (1e-5, -1e-5):
            w[place] = keep + d
            got.append(net.gradient(x, at, mine, weight)[0])
        w[place] = keep
        assert abs((got[0] - got[1]) / 2e-5 - g[name][place]) < 1e-4 * max(1, abs(g[name][place])), name
    every, some = np.ones(x.shape, bool), r.random(x.shape) < 0.7
    base = _plain(net, x, y)
    assert np.allclose(net.log_probability(x, y, every).reshape(x.shape), base)
    assert np.allclose(net.log_probability(x, y, some), base[some])
    assert abs(net.gradient(x, at, mine, weight)[0] + (np.take_along_axis(base, at, 1) * weight).sum() / weight.sum()) < 1e-9
    for name in ("query", "out"):  # as well where exponentials would overflow
        big = L.Attention(12, 3)
        big.w = {k: v * (400 if k == name else 1) for k, v in net.w.items()}
        assert np.allclose(big.log_probability(x, y, every).reshape(x.shape), _plain(big, x, y))
    x[:, 10:] = 0
    assert np.allclose(net.log_probability(x, y, every).reshape(x.shape)[:, :10], base[:, :10])


def test_probabilities_sum_to_one():
    r = np.random.default_rng(2)
    classes = L.Classes(r.integers(0, 50, 200).astype(float))
    net = L.Attention(200)
    x = r.integers(0, 200, (1, L.WINDOW))
    total = sum(np.exp(net.log_probability(x, np.full_like(x, classes.of[i]), np.ones(x.shape, bool)) + classes.inside[i]) for i in range(200))
    assert np.allclose(total, 1, atol=1e-4)


def test_batched_windows_equal_one_text_alone():
    model = vocabulary("piece_bpe_32k.model")
    counts = np.ones(len(SP._encoder(model, False).pieces.kinds))
    s = L.Scorer(model, L.Attention(len(counts)).w, counts)
    import pyarrow as pa

    texts = ["", "One two", "a b c " * 200, None, "One\ttwo"]
    buf, offsets = B.text_bytes(pa.array(texts))
    both = s.score(buf, offsets)
    for i, t in enumerate(texts):
        one, o = B.text_bytes(pa.array([t]))
        assert abs(s.score(one, o)[0] - both[i]) < 1e-3
    assert abs(both[1] - both[4]) < 1e-9


def base(rows):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, (_, t) in enumerate(rows)}
    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return Counter((rows[i][0], held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens.items())


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(9000, None), (9001, ""), (9002, " \n"), (9003, "A a\ta"), (9003, "A a\ta"), (None, "x"), (9004, "end " * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").repartition(5)
    out = L.lm_scores(spark, docs, vocabulary("piece_bpe_32k.model"), epochs=1, sample=50, block_bytes=1 << 17).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == base(rows)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    none = L.lm_scores(spark, docs.where("doc_id = 1"), vocabulary("piece_bpe_32k.model"), fold_of=1, fold=0).collect()
    assert none[0].train_tokens == 0 and none[0].base_score == 0 and none[0].n_known == 0
    assert L.lm_scores(spark, docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_training_helps_on_held_out_rows(spark):
    """The default path: one pass over all training rows."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = vocabulary("piece_bpe_32k.model")
    held = lambda df: sum(r.score for r in df.where("held_out").collect())
    trained, untrained = held(L.lm_scores(spark, docs, model)), held(L.lm_scores(spark, docs, model, epochs=0))
    print("gain", trained / untrained)
    assert trained > 0.95 * untrained


def test_every_input_is_a_target_of_training():
    """The targets of training are all pieces and ends, not a few places of each window."""
    size = np.array([1, L.WINDOW, 3 * L.WINDOW + 5])
    *_, counted, _ = L.layout(np.arange(int(size.sum())), np.concatenate(([0], np.cumsum(size))), 1, 2, L.WINDOW)
    at, weight = L.last_places(counted, L.WINDOW)
    assert weight.sum() == counted.sum() == size.sum() + len(size)
    assert all(sorted(a[w > 0]) == np.flatnonzero(c).tolist() for a, w, c in zip(at, weight, counted))


def test_all_places_in_order_give_the_same_gradient():
    r = np.random.default_rng(4)
    net = L.Attention(12, 3)
    net.w = {k: r.standard_normal(v.shape) for k, v in net.w.items()}
    x, y = r.integers(0, 12, (4, L.WINDOW)), r.integers(0, 9, (4, L.WINDOW))
    counted = np.arange(L.WINDOW) < np.array([[L.WINDOW], [2], [9], [L.WINDOW]])
    at, weight = L.last_places(counted, L.WINDOW)
    one, two = net.gradient(x, at, np.take_along_axis(y, at, 1), weight), net.gradient(x, None, y, counted.astype(float))
    assert abs(one[0] - two[0]) < 1e-12 and np.allclose(one[2], two[2])
    assert all(np.allclose(one[1][k], two[1][k]) for k in one[1])


def test_one_window_beyond_the_range_of_exponentials():
    """It is done again by its maximum; the others keep their numbers."""
    r = np.random.default_rng(5)
    net = L.Attention(12, 3)
    net.w = {k: r.standard_normal(v.shape) * 0.5 for k, v in net.w.items()}
    net.w["embed"][0] *= 400
    x, y = r.integers(1, 12, (4, L.WINDOW)), r.integers(0, 9, (4, L.WINDOW))
    x[2, 3] = 0
    every = np.ones(x.shape, bool)
    assert np.allclose(net.log_probability(x, y, every).reshape(x.shape), _plain(net, x, y))
    rest = [0, 1, 3]
    assert np.array_equal(net._mixed(*[net.w["embed"][x] + net.w["place"]] * 2, np.arange(L.WINDOW))[3][rest],
                          net._mixed(*[net.w["embed"][x[rest]] + net.w["place"]] * 2, np.arange(L.WINDOW))[3])


def test_texts_are_encoded_once(spark):
    """Counting, training and scoring read the pieces of the blocks: the table is read for its training rows and for the others."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(i, f"one two {i % 9}") for i in range(300)], "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    assert L.lm_scores(spark, docs, vocabulary("piece_bpe_32k.model"), block_bytes=1 << 9).count() == 300
    assert seen.value == 2 * 300


def test_blocks_hold_whole_runs():
    offsets = np.concatenate(([0], np.cumsum([400, 300, 200, 5000, 10, 600, 600])))
    blocks = list(L.runs_of_blocks(offsets, 1000))
    assert [r for b in blocks for r in b] == list(B.blocks(offsets, 1000))
    assert all(len(b) == 1 or offsets[b[-1][1]] - offsets[b[0][0]] <= 1000 for b in blocks)
    assert [len(b) for b in L.runs_of_blocks(np.arange(9) * (B.BLOCK // 2), 2 * B.BLOCK)] == [2, 2]


def test_new_segments_need_no_strings(monkeypatch):
    """Characters of all new segments of a block are taken at once."""
    import pyarrow as pa

    model = vocabulary("piece_bpe_32k.model")
    texts = ["One two", "", " lead", "trail ", "many   spaces \n\tß漢😀x", "漢 字", None, "x" * 200 + " yz"]
    buf, offsets = B.text_bytes(pa.array(texts))
    encode_segments = SP.Pieces.encode_segments
    monkeypatch.setattr(SP.Pieces, "encode_segments", None)
    encoder = SP.Encoder(model, False)
    ids, at, _ = encoder.encode(buf, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [encoder.pieces.library.encode(t or "") for t in texts]
    body, ends = np.array([0, 7, 8, 12]), np.array([3, 7, 12, 18])  # one of them empty, one with a space
    chars, size = SP.segment_chars(buf, body, ends)
    strings = [SP.MARK + buf[a:b].tobytes().decode().replace(" ", SP.MARK) for a, b in zip(body, ends)]
    assert size.tolist() == [len(s) for s in strings] and "".join(map(chr, chars)) == "".join(strings)
    assert [x.tolist() for x in encoder.pieces.encode_chars(chars, size)] == [x.tolist() for x in encode_segments(encoder.pieces, strings)]


def test_merges_in_rounds_equal_the_agenda_of_each_segment():
    pieces = SP._encoder(vocabulary("piece_bpe_32k.model"), False).pieces
    r = np.random.default_rng(6)
    segments = [SP.MARK + "".join(r.choice(list("aaabcdeetinorsh"), k)) for k in r.integers(0, SP.LONG, 400)]
    ids, n = pieces.encode_segments(segments)
    own = [pieces._heap([int(pieces.of_char[ord(c)]) for c in s])[1] for s in segments]
    assert n.tolist() == [len(x) for x in own] and ids.tolist() == sum(own, [])


def test_weights_are_summed_for_each_column_of_what_they_mix():
    """The division by the sums goes number by number; classes are numbers of 16 bits."""
    r = np.random.default_rng(7)
    net = L.Attention(12, 3)
    x = net.w["embed"][r.integers(0, 12, (4, L.WINDOW))]
    _, _, v, a, sums, mixed = net._mixed(x, x, np.arange(L.WINDOW))
    assert sums.shape == mixed.shape == v.shape and np.allclose(sums, a.sum(axis=2, keepdims=True))
    assert np.allclose(mixed, a / a.sum(axis=2, keepdims=True) @ v, atol=1e-6)
    assert L.Classes(r.integers(0, 50, 200).astype(float)).of.dtype == np.int16


def test_words_of_segments_equal_words_of_texts(spark):
    """Hashes of words are those that the encoder's segments have."""
    import pyarrow as pa

    texts = ["One two", "", " ", "   ", " lead", "\ttab\n\nlines  \r end ", None, "a", "ß 漢字   😀 ", "x" * 200 + " y z", "a▁b ▁", " ▁c"]
    for some in (texts, texts[:10], texts[:1], [""], []):
        buf, offsets = B.text_bytes(pa.array(some, pa.string()))
        starts, ends, at = B.word_spans(B.LOWER[buf], offsets)
        mine, my_at = L.word_hashes(L._NORMAL[buf], *SP.spans(L._NORMAL[buf], offsets))
        assert np.array_equal(mine, B.span_hashes(B.LOWER[buf], starts, ends)) and np.array_equal(my_at, at)
    rows = [(i, t) for i, t in enumerate(texts)]
    out = L.lm_scores(spark, spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("piece_bpe_32k.model")).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == base(rows)
