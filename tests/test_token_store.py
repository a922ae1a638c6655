import pytest
from pyspark.sql import functions as F

from tessera.operators import pack, tokenize
from tessera.sources.token_store import TokenStore

TEXTS = [" ".join(f"w{(7 * i + j) % 11}" for j in range(i % 9)) for i in range(60)]


def _docs(spark, n, change=None):
    return spark.createDataFrame([(i, "other" if i == change else t) for i, t in enumerate(TEXTS[:n])], "doc_id long, text string")


@pytest.fixture
def store(spark, tmp_path):
    vocab = tokenize.build_vocab(_docs(spark, 60))
    read = spark.sparkContext.accumulator(0)

    def encode(part):
        def seen(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return tokenize.encode(part.mapInArrow(seen, part.schema), vocab)

    s = TokenStore(spark, str(tmp_path / "store"), encode)
    s.count = read
    return s


def _rows(df):
    return sorted((r.doc_id, r.n_tokens, r.start, tuple(r.input_ids)) for r in df.collect())


def test_appended_equals_rebuilt(spark, store, tmp_path):
    versions = [store.sync(_docs(spark, n))["version"] for n in (20, 41, 41, 60)]
    assert versions == [1, 2, 2, 3] and store.count.value == 60  # each document tokenised once
    rebuilt = pack.token_offsets(tokenize.encode(_docs(spark, 60), tokenize.build_vocab(_docs(spark, 60))))
    assert _rows(store.read()) == _rows(rebuilt)
    assert [r[0] for r in _rows(store.read(1))] == list(range(20))
    whole = {r.chunk_id: r.input_ids for r in pack.pack_chunks(rebuilt, 8).collect()}
    for since in (0, 1, 2):
        first = store.manifest(since)["tokens"] // 8
        assert {r.chunk_id: r.input_ids for r in store.new_chunks(8, since).collect()} == {k: v for k, v in whole.items() if k >= first}


def test_a_changed_past_is_refused(spark, store):
    store.sync(_docs(spark, 20))
    with pytest.raises(ValueError, match="new store"):
        store.sync(_docs(spark, 30, change=5))
    with pytest.raises(ValueError, match="new store"):
        store.sync(_docs(spark, 30).filter("doc_id <> 7"))
    assert store.manifest()["version"] == 1


def test_broken_runs_leave_the_old_state(spark, store):
    store.sync(_docs(spark, 20))
    good = store.encode
    store.encode = lambda part: good(part).withColumn("input_ids", F.raise_error(F.lit("lost")).cast("array<int>"))
    with pytest.raises(Exception, match="lost"):
        store.sync(_docs(spark, 30))
    fs, path = store.manifests._fs(f"{store.root}/manifests/00000002.json")  # a writer that was lost half-way
    out = fs.create(path, False)
    out.write(bytearray(b'{"version": 2, "segm'))
    out.close()
    assert store.manifest()["version"] == 1 and store.read().count() == 20
    store.encode = good
    assert store.sync(_docs(spark, 30))["version"] == 3 and store.read().count() == 30


def test_only_one_of_two_runs_commits(spark, store):
    state = store.sync(_docs(spark, 20))
    with pytest.raises(Exception):
        store.manifests.commit(state)
    assert store.manifest() == state


def test_keys_must_be_unique_and_there(spark, store):
    twice = _docs(spark, 5).union(_docs(spark, 5).filter("doc_id = 2"))
    with pytest.raises(ValueError, match="not unique"):
        store.sync(twice)
    with pytest.raises(Exception, match="null in the order key"):
        store.sync(spark.createDataFrame([(None, "a")], "doc_id long, text string"))
    with pytest.raises(ValueError, match="empty"):
        store.read()


def test_subword_slot(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    model = tokenize.read_vocabulary(path)
    rows = [(1, "Plain words, Über 42\n\n  cats"), (1, "<|endoftext|> is text"), (None, ""), (2, None), (3, "long text " * 30_000), (4, "a\u0000b \U0001f600")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, extra string")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    want = sorted(((i, t, own.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=repr)
    enc = tokenize.encode_subwords(df, model, keep_text=True)
    assert sorted(((r.doc_id, r.text, r.input_ids) for r in enc.collect()), key=repr) == want
    back = tokenize.decode_subwords(enc, model)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert {r.input_ids[-1] for r in tokenize.encode_subwords(df, model, eos_id=50256).collect()} == {50256}
    assert max(len(r.input_ids) for r in tokenize.encode_subwords(df, model, max_length=3).collect()) == 3
    words = {r.word for r in tokenize.eligible_words(tokenize.subword_vocabulary(spark, model), need=1000).collect()}
    assert "the" in words and not any(not w.isalpha() or len(w) < 3 for w in words)
