"""Line-first quality rules, row by row with built-in functions only.

Each line with a word is judged by itself; lines that fail are removed, and a document that loses
too much of its text is rejected. A line fails if

* punctuation: ``long_line`` words or more without a single mark that ends or divides a sentence,
  or symbols ``#*$%&|<>`` make more than ``symbol_share`` of its characters;
* navigation: three or more menu separators (``|``, ``»``, ``›``, ``·`` or ``•`` between spaces), or
  four words in capitals on end;
* boilerplate: one of the phrases below, in a line of at most ``boilerplate_words`` words.

A line's words are counted by splitting it once, so a line or text of any length (one word of megabytes
included) takes time in proportion to its length.

Base figures of the whole text: words, their characters, symbols, repeated lines, and words in
3-word windows that the text has twice or more. Words are hashed once (64 bits); windows are compared by a hash of three hashes.

Null text: as the empty text, with zero counts, ``base_failed`` and not kept. Repeated rows give
repeated results, an empty table an empty result; other columns of the input are not read. All work
on a row stays in that row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Phrases of page furniture, lower case.
BOILERPLATE = [
    "all rights reserved", "accept cookies", "back to top", "click here", "cookie policy", "enable javascript",
    "forgot password", "log in", "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign in",
    "sign up", "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies",
]

DIVIDES = r"[.,;:!?…。！？、،؟।]"
MENU = r"([\x20\x09-\x0D][|»›·•][\x20\x09-\x0D][^\n]*){3}"
CAPITALS = r"(^|[^\p{L}])(\p{Lu}{2,}[^\p{L}]+){3}\p{Lu}{2,}"


def removed_line(matches: str, raw: str, line: str, words: str, symbol_share: float, long_line: int, boilerplate_words: int) -> str:
    """SQL condition that a line of so many words goes. All patterns mean the same in Java and RE2; ``raw``: the
    prefix of a string literal without escapes. The cheap tests stand first; no pattern counts words."""
    def like(pattern: str) -> str:
        return f"{matches}({line}, {raw}'{pattern}')"

    symbols = f"length({line}) - length(translate({line}, '{SYMBOLS}', ''))"
    return f"""({symbols} > {symbol_share} * length({line})
        or ({words} >= {long_line} and not {like(DIVIDES)})
        or ({words} <= {boilerplate_words} and {like(f"(?i)({'|'.join(BOILERPLATE)})")})
        or {like(MENU)} or {like(CAPITALS)})"""


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", symbol_share: float = 0.1, long_line: int = 12,
                  boilerplate_words: int = 15, most_lost: float = 0.5, least_words: int = 50, most_repeated: int = 50,
                  with_text: bool = False) -> DataFrame:
    """Of each row: key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept``, ``n_lines``, ``n_removed_lines``, ``lost_share``; on demand the cleaned text."""
    bad = removed_line("rlike", "r", "x.l", "x.n", symbol_share, long_line, boilerplate_words)
    d = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select(
        "k", F.expr(f"filter(split(t, r'{SPLIT}'), w -> w <> '')").alias("words"),
        F.expr(r"filter(split(t, '\n'), l -> rlike(l, r'[^\x20\x09-\x0D]'))").alias("lines"),
        F.length(F.translate("t", SEPARATORS, "")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
    )
    d = d.selectExpr(
        "k", "size(words) as n_words", "word_chars", "n_symbols", "lines", "size(lines) - size(array_distinct(lines)) as n_dup_lines",
        f"transform(filter(transform(lines, l -> struct(l as l, size(split(btrim(l, '{SEPARATORS}'), r'{SPLIT}')) as n)), x -> not {bad}), x -> x.l) as good",
        "transform(words, w -> xxhash64(w)) as hashes",
    )
    d = d.selectExpr(
        "*",
        # hashes is read three times, so the optimiser doesn't put the words into the lambda
        "case when size(hashes) < 4 then array() else transform(sequence(0, size(hashes) - 3), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2])) end as windows",
    )
    d = d.selectExpr(
        "*", "case when size(array_distinct(windows)) = size(windows) then array() else array_sort(transform(windows, (h, i) -> struct(h as h, i as i))) end as ordered",
        "aggregate(lines, 0, (n, l) -> n + length(l)) as line_chars", "aggregate(good, 0, (n, l) -> n + length(l)) as good_chars",
    )
    d = d.selectExpr(
        "*", """size(array_distinct(flatten(transform(
            filter(ordered, (x, j) -> coalesce(get(ordered, j - 1).h = x.h, false) or coalesce(get(ordered, j + 1).h = x.h, false)),
            x -> array(x.i, x.i + 1, x.i + 2))))) as n_repeat_words""",
        "1 - good_chars / greatest(line_chars, 1) as lost_share",
    )
    d = d.withColumn("base_failed", F.expr(f"n_words < {least_words} or 100L * n_repeat_words > {most_repeated}L * n_words"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = d.select(
        F.col("k").alias(key), *[F.col(c).cast("long").alias(c) for c in longs], "base_failed",
        F.expr(f"not base_failed and lost_share <= {most_lost}").alias("kept"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_removed_lines"), "lost_share",
        *([F.array_join("good", "\n").alias("cleaned")] if with_text else []),
    )
    return out


def oracle_sql(symbol_share: float = 0.1, long_line: int = 12, boilerplate_words: int = 15, most_lost: float = 0.5) -> str:
    """The same in DuckDB's SQL, with windows compared as texts."""
    bad = removed_line("regexp_matches", "", "l", "n", symbol_share, long_line, boilerplate_words)
    return rf"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '{SPLIT}'), lambda x: x <> '') as words,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
    grams as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
    again as (select r, i, count(*) over (partition by r, g) as n from grams),
    covered as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from again where n > 1) group by r),
    ln as (select r, l, len(regexp_split_to_array(trim(l, '{SEPARATORS}'), '{SPLIT}')) as n from (select r, unnest(lines) as l from w)),
    good as (select r, count(*) as n_lines, count(*) filter (where {bad}) as n_removed_lines, sum(length(l)) as chars,
             coalesce(sum(length(l)) filter (where not {bad}), 0) as good_chars from ln group by r),
    f as (select w.r, doc_id, len(words) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
          coalesce(c.n, 0) as n_repeat_words, coalesce(g.n_lines, 0) as n_lines, coalesce(g.n_removed_lines, 0) as n_removed_lines,
          1 - coalesce(good_chars, 0)::double / greatest(coalesce(chars, 0), 1)::double as lost_share
          from w left join covered c on c.r = w.r left join good g on g.r = w.r)
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
      n_repeat_words::bigint as n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
      not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost_share <= {most_lost} as kept,
      n_lines::bigint as n_lines, n_removed_lines::bigint as n_removed_lines, lost_share from f"""
