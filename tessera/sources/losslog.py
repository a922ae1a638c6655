"""Loss-log JSON source and sink.

Reference format: one JSON object ``{run_name: {"train/global_step": [...],
"train/loss": [...]}}``.  The sink also offers JSON Lines (one run per line,
written in parallel), which the source reads as well.

One large object is read by many tasks: Spark's text reader takes ``}`` as the end of a record, so the byte ranges
of a file give one piece a run. A first pass proves of each file that its pieces are the runs of one
object (one opens it, the others follow a comma, each closes one brace, one brace is left at the end, all bytes are
accounted for). Files of another shape (braces in names, deeper values, no runs, compressed, malformed) are parsed whole, one
task each, and fail the job if they are no JSON object. Only the paths of such files reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Key names of the loss-log format.
STEP_KEY = "train/global_step"
LOSS_KEY = "train/loss"

_RUN_STRUCT = f"struct<`{STEP_KEY}`: array<double>, `{LOSS_KEY}`: array<double>>"


def read_loss_log(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """-> ``run_name STRING, steps ARRAY<DOUBLE>, losses ARRAY<DOUBLE>``.

    A malformed file fails the job instead of yielding nulls. A run that an object names twice gives two rows, missing
    keys are empty arrays; an empty file has no runs. With ``lines=False`` files are looked through once when this is called.
    """
    if lines:
        schema = f"run_name string, `{STEP_KEY}` array<double>, `{LOSS_KEY}` array<double>"
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return df.select("run_name", F.col(f"`{STEP_KEY}`").alias("steps"), F.col(f"`{LOSS_KEY}`").alias("losses"))
    other = [r.file for r in _of_another_shape(_pieces(spark, path)).collect()]
    pieces = _pieces(spark, path)
    runs = pieces.filter(~F.col("file").isin(other) & ~F.col("value").rlike(_BLANK)) if other else pieces.filter(~F.col("value").rlike(_BLANK))
    obj = F.concat(F.lit("{"), F.regexp_replace("value", r"^\s*[{,]", ""), F.lit("}}"))
    parsed = runs.select(F.explode(F.from_json(obj, f"map<string, {_RUN_STRUCT}>", {"mode": "FAILFAST"})).alias("run_name", "r"))
    none = F.array().cast("array<double>")
    found = parsed.select("run_name", *(F.coalesce(F.col("r").getField(k), none).alias(c) for k, c in _COLUMNS.items()))
    if not other:
        return found
    return found.union(spark.read.text([_glob_safe(p) for p in other], wholetext=True).mapInPandas(_whole_objects, found.schema))


_COLUMNS = {STEP_KEY: "steps", LOSS_KEY: "losses"}
_BLANK = r"^[ \t\r\n]*$"


def _glob_safe(path: str) -> str:
    """The path as a pattern that names this file alone."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, size, block): what stands between closing braces, in as many tasks as the bytes need."""
    return spark.read.option("lineSep", "}").text(path).select(
        "value", F.expr("reflect('java.net.URLDecoder', 'decode', replace(_metadata.file_path, '+', '%2B'), 'UTF-8')").alias("file"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"))


def _of_another_shape(pieces: DataFrame) -> DataFrame:
    """(file): the files whose pieces are not just the runs of one object.

    Pieces of a file are ordered by the start of their byte range and their place within it.
    """
    bare = F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '"[^"]*"', "")
    kind = (F.when(F.col("value").rlike(_BLANK), "blank").when(bare.rlike(r'^\s*\{\s*:\s*\{[^{"]*$'), "first")
            .when(bare.rlike(r'^\s*,\s*:\s*\{[^{"]*$'), "next").otherwise("other"))
    placed = pieces.select("file", "size", F.octet_length("value").alias("bytes"), kind.alias("kind"),
                           F.struct("block", F.monotonically_increasing_id()).alias("at"))

    def of(k):
        return F.col("kind") == k

    run = of("first") | of("next")
    s = placed.groupBy("file").agg(
        F.count_if(of("first")).alias("firsts"), F.count_if(run).alias("runs"), F.count_if(of("other")).alias("others"),
        F.min("at").alias("start"), F.min(F.when(of("first"), F.col("at"))).alias("first_at"),
        F.max(F.when(run, F.col("at"))).alias("last_at"), F.min(F.when(of("blank"), F.col("at"))).alias("blank_at"),
        (F.max("size") - F.sum("bytes")).alias("braces"))
    # bytes that no piece holds are closing braces: one a run, and the object's own, which blanks alone follow
    plain = ((F.col("firsts") == 1) & (F.col("others") == 0) & (F.col("start") == F.col("first_at"))
             & (F.col("last_at") < F.col("blank_at")) & (F.col("braces") == F.col("runs") + 1))
    return s.filter(~F.coalesce(plain, F.lit(False))).select("file")


def _whole_objects(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for text in part["value"]:
            runs = json.loads(text, object_pairs_hook=lambda pairs: pairs)
            if not text.lstrip().startswith("{"):
                raise ValueError("a loss log is one JSON object")
            rows = [(name, *([None if x is None else float(x) for x in dict(run).get(k) or []] for k in _COLUMNS)) for name, run in runs]
            yield pd.DataFrame(rows, columns=["run_name", *_COLUMNS.values()])


def write_loss_log(packed: DataFrame, path: str, single_object: bool = False) -> str:
    """Inverse of S5 for ``run_name, steps, losses`` rows (R3 output).

    JSON Lines, written and read in parallel, one run a line.  ``single_object`` asks for the
    one-file format of other tools: one task writes that file, run by run in the order of their names.
    """
    if not single_object:
        (packed.select("run_name", F.col("steps").alias(STEP_KEY), F.col("losses").alias(LOSS_KEY))
         .write.mode("overwrite").json(path))
        return path
    one = F.to_json(F.create_map("run_name", F.struct(F.col("steps").alias(STEP_KEY), F.col("losses").alias(LOSS_KEY))))
    rows = packed.select(F.lit(0).alias("end"), "run_name", F.substring(one, F.lit(2), F.length(one) - 2).alias("text"))
    end = packed.sparkSession.range(1).select(F.lit(1).alias("end"), F.lit(None).cast("string").alias("run_name"), F.lit("}").alias("text"))
    lines = rows.union(end).repartition(1).sortWithinPartitions("end", "run_name").withColumn("at", F.monotonically_increasing_id())
    before = F.when(F.col("at") == 0, "{").when(F.col("end") == 0, ",").otherwise("")
    lines.select(F.concat(before, "text").alias("value")).write.mode("overwrite").text(path)
    return path
