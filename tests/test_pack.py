import pytest
from pyspark.sql import functions as F

from tessera.functions import prefix
from tessera.operators import pack

C = 4


def _tokens(spark, parts=None):
    rows = [(0, []), (1, [1, 2, 3, 4]), (2, [5, 6, 7, 8, 9]), (3, list(range(10, 22))), (4, [22]), (5, [])]
    df = spark.createDataFrame(rows, "doc_id long, input_ids array<int>")
    return df.repartition(parts) if parts else df


def _chunks(spark, parts=None):
    tok = _tokens(spark, parts)
    off = pack.token_offsets(tok, rows_per_range=2)
    return sorted((r.chunk_id, tuple(r.input_ids)) for r in pack.pack_chunks(off, C).collect())


def test_chunks_exact_and_tail_dropped(spark):
    ch = _chunks(spark)
    stream = [1, 2, 3, 4, 5, 6, 7, 8, 9] + list(range(10, 22)) + [22]
    expect = [(i, tuple(stream[i * C:(i + 1) * C])) for i in range(len(stream) // C)]
    assert ch == expect
    assert all(len(ids) == C for _, ids in ch)


def test_partition_invariance(spark):
    base = _chunks(spark)
    for p in (1, 3, 16):
        assert _chunks(spark, p) == base


def test_packing_stats(spark):
    st = pack.packing_stats(_tokens(spark), C).first()
    assert st.total_tokens == 22 and st.usable_tokens == 20 and st.dropped_tokens == 2 and st.num_chunks == 5
    assert st.total_tokens - st.usable_tokens < C


def test_running_total_matches_python(spark):
    df = spark.range(0, 1000, 7).withColumn("v", (F.col("id") % 13).cast("long"))
    got = {r.id: r.s for r in prefix.running_total(df, "id", "v", "s", rows_per_range=10).collect()}
    place = {r.id: r.p for r in prefix.dense_index(df.select("id"), [F.col("id").desc()], "p").collect()}
    acc = 0
    for i in range(0, 1000, 7):
        assert got[i] == acc and place[i] == (994 - i) // 7
        acc += i % 13


def test_offsets_keep_empty_documents_and_refuse_null_keys(spark):
    rows = {r.doc_id: (r.n_tokens, r.start) for r in pack.token_offsets(_tokens(spark)).collect()}
    assert rows == {0: (0, 0), 1: (4, 0), 2: (5, 4), 3: (12, 9), 4: (1, 21), 5: (0, 22)}
    with pytest.raises(Exception, match="null in the order key"):
        pack.token_offsets(spark.createDataFrame([(None, [1])], "doc_id long, input_ids array<int>"))


def test_no_ids_under_a_window(spark):
    plan = pack.pack_chunks(pack.token_offsets(_tokens(spark)), C)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert "input_ids" not in below.split("Relation")[0]


def test_cache_is_named_by_content_and_reused(spark, tmp_path):
    made = []

    def make(df):
        made.append(1)
        return df

    def ask(text):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return pack.cached_offsets(spark, str(tmp_path), tuple(pack.corpus_fingerprint(docs).first()), lambda: make(docs))

    assert [ask("a b")[1], ask("a b")[1], ask("c d")[1], ask("a b")[1]] == [False, True, False, True]
    assert len(made) == 2 and ask("c d")[0].first().text == "c d"


def test_lengths_that_do_not_nest(spark):
    out = pack.pack_many(pack.token_offsets(_tokens(spark)), [3, 4]).groupBy("chunk_len").count().collect()
    assert {r.chunk_len: r["count"] for r in out} == {3: 7, 4: 5}


def test_multi_length_shares_offsets(spark):
    off = pack.token_offsets(_tokens(spark))
    out = pack.pack_many(off, [2, 4]).groupBy("chunk_len").count().collect()
    assert {r.chunk_len: r["count"] for r in out} == {2: 11, 4: 5}
