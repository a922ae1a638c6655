import pytest
from pyspark.sql import functions as F

from tessera.operators import tokenize


def test_encode_matches_vocab(spark):
    df = spark.createDataFrame([(1, "the cat, the hat!"), (2, ""), (3, "Über 42 cat")], "doc_id long, text string")
    vocab = tokenize.build_vocab(df, "text", max_size=3)
    v = {r.token: r.token_id for r in vocab.collect()}
    # count desc, then token (binary order): cat/the tie at 2, then "!" first of the singletons
    assert v == {"cat": 2, "the": 3, "!": 4}
    enc = {r.doc_id: r.input_ids for r in tokenize.encode(df, vocab).collect()}
    assert enc[2] == []
    assert enc[1] == [3, 2, 0, 3, 0, 4]
    assert enc[3] == [0, 0, 2]


def test_eos_and_truncate(spark):
    df = spark.createDataFrame([(1, [5, 6, 7])], "doc_id long, input_ids array<int>")
    assert tokenize.add_eos(df).first().input_ids == [5, 6, 7, tokenize.EOS_ID]
    assert tokenize.truncate(df, 2).first().input_ids == [5, 6]


def test_id_range_raises(spark):
    df = spark.createDataFrame([(1, [70000])], "doc_id long, input_ids array<int>")
    with pytest.raises(Exception):
        tokenize.assert_id_range(df, "uint16").collect()
    assert tokenize.assert_id_range(df, "uint32").count() == 1


def test_eligible_words(spark):
    v = spark.createDataFrame([(" abc",), ("ab",), ("abc",), ("a1c",), ("Word",)], "token string")
    assert sorted(r.word for r in tokenize.eligible_words(v).collect()) == ["Word", "abc"]


def test_no_token_is_lost_without_a_stated_size(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "c, d!")], "doc_id long, text string")
    vocab = tokenize.build_vocab(df)
    enc = {r.doc_id: r.input_ids for r in tokenize.encode(df, vocab).collect()}
    assert enc[2] == enc[3] == [] and all(tokenize.UNK_ID not in x for x in enc.values())
    back = {r.token_id: r.token for r in vocab.collect()}
    assert sorted(back) == list(range(tokenize.RESERVED, tokenize.RESERVED + 6))
    assert [back[i] for i in enc[1]] == ["a", "b", "a"] and [back[i] for i in enc[4]] == ["c", ",", "d", "!"]
    in_memory = {t: i for i, t in back.items()}
    same = {r.doc_id: r.input_ids for r in tokenize.encode(df.filter("text is not null"), in_memory).collect()}
    assert same == {k: v for k, v in enc.items() if k != 2}


def _both_ways(spark, rows, schema, **kw):
    df = spark.createDataFrame(rows, schema)
    vocab = tokenize.build_vocab(df.select("text"))
    out = [sorted((tuple(r) for r in way(df, vocab, **kw).collect()), key=repr) for way in (tokenize.encode_by_table, tokenize.encode_by_join)]
    assert out[0] == out[1]
    return out[0], {r.token: r.token_id for r in vocab.collect()}


def test_rows_that_share_an_id_or_have_none_stay_apart(spark):
    rows = [(1, "a b c"), (1, "d e"), (None, "a"), (None, "b c"), (2, ""), (3, None), (1, "d e")]
    out, ids = _both_ways(spark, rows, "doc_id long, text string")
    assert out == sorted(((i, [ids[t] for t in (x or "").split()]) for i, x in rows), key=repr)


def test_the_long_way_in_many_blocks(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 23)), i % 3, "kept") for i in range(300)] + [(999, "long " * 5000, 1, None)]
    out, _ = _both_ways(spark, rows, "doc_id long, text string, block long, tokens string", keep_columns=True)
    df = spark.createDataFrame(rows, "doc_id long, text string, block long, tokens string")
    vocab = tokenize.build_vocab(df)
    small = sorted((tuple(r) for r in tokenize.encode_by_join(df, vocab, keep_columns=True, block_tokens=50).collect()), key=repr)
    assert small == out and all(tokenize.UNK_ID not in r[-1] for r in out)
    assert tokenize.encode_by_join(df.limit(0), vocab).count() == 0


def test_a_vocabulary_over_the_bound_is_joined(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    vocab = tokenize.build_vocab(df)
    here = lambda: tokenize.encode(df, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in here()
    want = sorted(tuple(r) for r in tokenize.encode(df, vocab).collect())
    monkeypatch.setattr(tokenize, "BROADCAST_TOKENS", 2)
    assert "Exchange" in here()
    assert sorted(tuple(r) for r in tokenize.encode(df, vocab).collect()) == want


def test_an_encoder_gets_bounded_runs_of_texts(spark):
    def sizes():
        return lambda texts: [[len(texts), sum(len(t or "") for t in texts)] for _ in texts]

    df = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "case when id = 7 then repeat('x', 3000000) when id % 5 <> 0 then repeat('y', 1500) end as text")
    rows = sorted(tokenize.encode_with(df, sizes).collect())
    assert [r.doc_id for r in rows] == list(range(4000)) and rows[7].input_ids[1] >= 3_000_000
    assert all(r.input_ids[0] <= tokenize.ENCODE_ROWS and (r.input_ids[1] <= tokenize.ENCODE_BYTES or r.input_ids[0] == 1) for r in rows)


def test_blocks_hold_a_bounded_number_of_tokens(spark, monkeypatch, tmp_path):
    """What a task of Python holds follows neither the rows of an Arrow batch nor the table."""
    docs = spark.range(1200, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7, F.repeat(F.lit(" of it"), 500)).alias("text"))
    vocab = spark.createDataFrame([("of", 2), ("it", 3), *[(f"w{i}", 4 + i) for i in range(6)]], "token string, token_id int")
    monkeypatch.setattr(tokenize, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        out = tokenize.encode_by_join(docs, vocab)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
        blocks = spark.read.parquet(f"{tmp_path}/blocks").agg(F.max(F.octet_length("places")), F.sum(F.octet_length("places"))).first()
        bad = out.where("size(input_ids) <> 1001 or input_ids[0] <> if(doc_id % 7 = 6, 0, 4 + doc_id % 7) or slice(input_ids, 2, 1000) <> flatten(array_repeat(array(2, 3), 500))").count()
        assert bad == 0 and out.count() == 1200
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert blocks[0] <= 4 * 500_000 and blocks[1] == 4 * 1200 * 1001
