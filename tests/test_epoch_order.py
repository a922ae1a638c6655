from pyspark.sql import functions as F

from tessera.functions import prefix
from tessera.functions.hashing import permuted
from tessera.operators import batching


def test_bijection_for_many_sizes(spark):
    sizes = [*range(1, 80), 100, 127, 128, 129, 1000, 4095, 4096, 4097, 10_007]
    rows = spark.range(len(sizes)).select(F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") + 1).cast("int")).cast("long").alias("n"))
    rows = rows.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"))
    placed = rows.withColumn("pos", permuted("x", "n", "3", "1"))
    bad = placed.groupBy("n").agg(F.count_distinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("c")).where("d <> n or lo <> 0 or hi <> n - 1 or c <> n")
    assert bad.count() == 0


def test_very_large_sizes_stay_in_range(spark):
    n = 3_000_000_000_017
    rows = spark.range(200).select((F.col("id") * 15_000_000_000 + 7).alias("x")).withColumn("pos", permuted("x", f"{n}L", "1", "0"))
    got = [r.pos for r in rows.collect()]
    assert len(set(got)) == 200 and all(0 <= p < n for p in got) and max(got) > n // 2 > min(got)


def test_epochs_and_seeds_differ_and_look_shuffled(spark):
    chunks = spark.range(2000).select(F.col("id").alias("chunk_id"))
    orders = {}
    for seed, epoch in ((1, 0), (1, 1), (2, 0)):
        rows = batching.epoch_order(chunks, seed, epoch).collect()
        pos = [r.pos for r in sorted(rows, key=lambda r: r.chunk_id)]
        assert sorted(pos) == list(range(2000))
        orders[seed, epoch] = pos
        steps = [abs(a - b) for a, b in zip(pos, pos[1:])]
        assert 500 < sum(steps) / len(steps) < 850  # two random places of n lie n / 3 apart
    assert len({tuple(v) for v in orders.values()}) == 3
    assert sum(a == b for a, b in zip(orders[1, 0], orders[1, 1])) < 12


def test_no_exchange_for_the_place(spark):
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.array(F.col("id")).alias("input_ids"))
    plan = batching.epoch_order(chunks, 1, 0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Join" not in plan


def test_keys_that_are_not_dense(spark):
    chunks = spark.createDataFrame([(10 * i + 3, "x") for i in range(40)], "chunk_id long, extra string")
    rows = batching.epoch_order(chunks, 1, 0).collect()
    assert sorted(r.pos for r in rows) == list(range(40)) and set(rows[0].asDict()) == {"chunk_id", "extra", "pos", "epoch"}
    assert batching.epoch_order(chunks.limit(0), 1, 0).count() == 0


def test_ranged_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(3000).mapInArrow(count, "id long")
    total = prefix.running_total(df, "id", None, "place", rows_per_range=500)
    assert [r.place for r in total.orderBy("id").collect()] == list(range(3000))
    assert seen.value == 3000
