"""Token counts and SentencePiece against the libraries on edge rows, whole texts and random texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bytewords as B
from tessera.llm import sentencepiece_bpe as SP
from tessera.llm import token_counts as TC
from tessera.llm.queries import vocabulary

EDGES = ["", " ", "  ", "   z", "  a", "z ", "▁a▁▁b", "a\tb\nc", "é" * 200, "x" * 300, "日本語テキスト 漢字", " \x00 b", "<s> </s> <0x41>", "🙂🙂 a",
         "a" * 70 + " " * 40 + "b", "don't  IT'S <|endoftext|>x <|startoftext|> a", "é ́x", "A.B.C. ΑΣ Σ", "same", "same", None]


def texts():
    rng = random.Random(5)
    alphabet = " ▁abcdeèéß\n\t日🙂0159.,<>|́"
    return EDGES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(300)] + ["lorem ipsum dolor " * 30_000, "q" * 5000]


def test_counts_equal_the_library():
    rows = texts()
    buf, offsets = B.text_bytes(pa.array(rows))
    for name, long_text in (("word_bpe_49k.json", TC.LONG_TEXT), ("byte_bpe_50k.json", 500)):
        of = TC.counter(vocabulary(name), long_text)
        got = np.concatenate([of(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in B.blocks(offsets)])
        want = [len(e.ids) for e in TC._tokenizer(vocabulary(name)).encode_batch([r or "" for r in rows], add_special_tokens=False)]
        assert got.tolist() == want


def test_white_space_probe():
    assert TC.drops_white_space(TC._tokenizer(vocabulary("word_bpe_49k.json")))
    assert not TC.drops_white_space(TC._tokenizer(vocabulary("byte_bpe_50k.json")))


@pytest.mark.parametrize("keep", [1 << 23, 64])
def test_sentencepiece_equals_the_library_without_its_check(keep):
    rows = texts()
    enc = SP.Encoder(vocabulary("piece_bpe_32k.model"), check=False, keep_ids=keep)
    buf, offsets = B.text_bytes(pa.array(rows))
    out = []
    for i, j in B.blocks(offsets, 1 << 16):
        out += SP._digests(enc, pa.array(range(i, j)), buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], True, True).to_pylist()
    library = enc.pieces.library
    for row, text in zip(out, rows):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_decode_of_any_ids_equals_the_library():
    p = SP.Pieces(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 300, rng.integers(0, 30)).tolist() for _ in range(300)] + [rng.integers(3, p.n, 20).tolist() for _ in range(300)]
    at = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    got = p.decode_bytes(np.array([i for r in runs for i in r]), at)
    assert [g.decode() for g in got] == [p.library.decode(r) for r in runs]


def test_queries_on_rows_with_nulls_and_clashing_names(spark):
    rows = [(None if i == 3 else i, t, i, "k") for i, t in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string")
    counts = TC.token_counts(spark, docs, vocabulary("word_bpe_49k.json"))
    assert counts.columns == ["doc_id", "n_bytes", "n_tokens"] and counts.count() == len(rows)
    pieces = SP.encode_decode(spark, docs, vocabulary("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in pieces.collect()}[len(EDGES) - 1] == 2
    assert SP.encode_decode(spark, docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0
    assert TC.token_counts(spark, docs.limit(0), vocabulary("word_bpe_49k.json")).count() == 0
