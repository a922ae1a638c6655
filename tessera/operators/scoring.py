"""Answer parsing, per-task scoring, accuracy, ablation drop, ranking.

Input is a generations table ``(run, task, layer_index NULL=baseline,
sample_id, prompt, answer, text)``.  Every parser is a built-in expression
(no UDF); regexes are written so Java and RE2 agree with Python's Unicode
semantics (see ``functions.text``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PY_LINE_BREAK, py_strip
from . import tasks as G

WORD_RUN = r"[\p{L}\p{N}_]+"          # Python \w+ on str
PY_SPLIT = r"[\t\n\x0B\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def first_int(text: Column) -> Column:
    """First run of (Unicode) digits, '' when none."""
    return F.regexp_extract(text, r"\p{Nd}+", 0)


def contains_gold(text: Column, gold: Column) -> Column:
    """Gold anywhere in the text (so gold 1 matches 12)."""
    return F.coalesce(F.contains(text, gold), F.lit(False))


def var_set(text: Column, prefix: str = "X") -> Column:
    """Sorted distinct whole words ``X<digits>`` (word = maximal run of
    word characters, the same as Python's ``\\bX\\d+\\b``)."""
    runs = F.regexp_extract_all(text, F.lit(WORD_RUN), 0)
    return F.array_sort(F.array_distinct(F.filter(runs, lambda w: w.rlike("^" + prefix + r"\p{Nd}+$"))))


def py_split(s: Column) -> Column:
    """``str.split()``: runs of whitespace, no empty strings."""
    return F.filter(F.split(s, PY_SPLIT), lambda w: w != "")


def prompt_words(prompt: Column) -> Column:
    """Words between 'separated by spaces:\\n' and '\\nWhat are' (shortest, dot matches newline)."""
    return py_split(F.regexp_extract(prompt, r"(?s)separated by spaces:\n(.*?)\nWhat are", 1))


def top_k_tokens(text: Column, allowed: Column, k) -> Column:
    """E5: cut at the first 'Explanation'; tokens ``[A-Za-z0-9_]+`` that are in
    ``allowed``, first occurrences in order, at most ``k`` (k = 0 -> empty)."""
    cut = F.substring_index(text, "Explanation", 1)
    toks = F.filter(F.regexp_extract_all(cut, F.lit("[A-Za-z0-9_]+"), 0), lambda t: F.array_contains(allowed, t))
    k_c = k if isinstance(k, Column) else F.lit(k)
    return F.when(k_c <= 0, F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(toks), 1, k_c))


def first_line(text: Column) -> Column:
    """E8 helper: first line of ``splitlines()``, stripped; null for empty text."""
    return F.when(F.length(text) == 0, F.lit(None)).otherwise(py_strip(F.split(text, PY_LINE_BREAK, 2)[0]))


def with_references(tasks: DataFrame) -> DataFrame:
    """Adds what scoring needs of a sample, ``allowed`` (E4) and ``gold_words``; done once per sample,
    before its answers are joined or repeated, not for each answer or token."""
    lists = F.col("task").isin(G.CWE, G.FWE)
    return (tasks.withColumn("allowed", F.when(lists, prompt_words(F.col("prompt"))))
            .withColumn("gold_words", py_split(F.col("answer"))))


def correct(task: Column, text: Column, gold: Column, allowed: Column, gold_words: Column) -> Column:
    """E1-E8 dispatch: one CASE over the task name; unknown tasks score false."""
    return (F.when(task == G.RETRIEVAL, first_int(text) == gold)
            .when(task.isin(G.AR, G.AR_MULTIHOP), contains_gold(text, gold))
            .when(task == G.VT, var_set(text) == F.array_sort(F.array_distinct(gold_words)))
            .when(task == G.CWE, F.array_sort(F.array_distinct(top_k_tokens(text, allowed, F.size(gold_words))))
                  == F.array_sort(F.array_distinct(gold_words)))
            .when(task == G.FWE, top_k_tokens(text, allowed, 3) == gold_words)
            .when(task == G.PHONE_BOOK, F.coalesce(first_line(text) == gold, F.lit(False)))
            .otherwise(F.lit(False)))


def score(gens: DataFrame) -> DataFrame:
    """Adds ``correct`` (boolean) to every generation row; see :func:`with_references`."""
    if "allowed" not in gens.columns:
        gens = with_references(gens)
    cols = (F.col(c) for c in ("task", "text", "answer", "allowed", "gold_words"))
    return gens.withColumn("correct", F.coalesce(correct(*cols), F.lit(False)))


def accuracy(scored: DataFrame) -> DataFrame:
    """Correct / samples per (run, task, layer); partial aggregate."""
    return scored.groupBy("run", "task", "layer_index").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_samples"))


def ablation_drop(acc: DataFrame) -> DataFrame:
    """Baseline accuracy (layer null) minus each layer's accuracy.

    The window is per (run, task): one row per layer, bounded by model depth.
    """
    w = Window.partitionBy("run", "task")
    base = F.max(F.when(F.col("layer_index").isNull(), F.col("accuracy"))).over(w)
    return (acc.withColumn("baseline_accuracy", base)
            .filter(F.col("layer_index").isNotNull())
            .withColumn("performance_drop", F.col("baseline_accuracy") - F.col("accuracy")))


def importance_rank(drops: DataFrame) -> DataFrame:
    """Larger drop = more important (rank 1); ties by layer."""
    w = Window.partitionBy("run", "task").orderBy(F.col("performance_drop").desc(), "layer_index")
    return drops.withColumn("importance_rank", F.row_number().over(w))
