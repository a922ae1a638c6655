"""Conversation structure repair: cheapest edits by a rank-convergence parallel Viterbi.

Rows of a conversation stand by turn (null turns first). A row's first fault counts: *blank* (no character
but white space), *duplicate* (role and text seen earlier in the conversation), *truncated* (its last such character
is not one of ``.!?``). Edits make the role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 3,
Delete 4 (the only edit of blank and duplicate rows), Insert an empty user or assistant row 3; a truncated row that is
not deleted adds 3. Of the cheapest lists of edits the one whose initials are least in ASCII counts.

Four states say what may follow: nothing yet (0), after the system row (1), after a user row (2), after an
assistant row (3). An edit's letter and the state fix the next state, so the letters alone are the audit.

1. The rows are range-partitioned by conversation, turn and a digest of role and text, so a conversation
   of any size spreads over tasks, and cut into *chunks* of at most ``chunk_rows`` rows or ``chunk_bytes`` of text. A
   conversation that lies inside one task and chunk is finished there; the steps below are for the others.
2. Duplicates across chunks: the first chunk of each digest, by one sum over narrow rows.
3. Every chunk runs backward from a speculative cost vector (that of an end). A vector is kept less its least
   cost; the rest is a constant that is only added up.
4. Fix-up passes: a chunk whose follower now starts with another vector runs again from that one, until no vector differs
   by more than a constant. In a pass the chunks of a group run one after the other; groups grow sixteenfold
   a pass, so there are at most ``log16`` of the chunks of the longest conversation, however slowly its vectors converge.
5. The stitched vectors give each chunk's cheapest edits from each of the four states, hence a map from its first state
   to its last. Running compositions of those maps give each chunk's first state, and it is traced from there.
6. The traced pieces of a conversation are read in order by one task as a stream (SHA-256 has no other way); only
   the audit, which is part of the result, is held whole.

Null turns stand first; null roles and texts are one space; a null id is a conversation of its own. Rows that share a turn
stand in the order of their digests; equal rows count one by one. A role that is empty or begins with another letter
than s, u or a is never kept as it is. Very long texts make chunks of their own. An empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import written

CHUNK_ROWS, CHUNK_BYTES = 256, 1 << 20
WIDER = 16  # a fix-up pass has groups so many times as long as the one before
GROUP = 1024  # chunks whose maps one group composes

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP = {(0, 2): 1, (0, 0): 2, (1, 0): 2, (2, 1): 3, (3, 0): 2}  # (state, initial): next state; initials u a s
ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # what Rerole and Insert make in a state
NEXT = (2, 2, 3, 2)  # and the state after it
TRUNCATED, FORCED, OTHER = 4, 8, 3
BLANK = 16
END = (0, 6, 3, 0)
LEGAL = {(2, 0), (0, 1), (1, 0)}

_steps: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int]] = {}


def step(after: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """The vector before a row of this kind and its constant, from the vector after it."""
    found = _steps.get((after, kind))
    if found is None:
        costs = []
        for s in range(4):
            c = 4 + after[s]
            if kind < FORCED:
                late, initial = 3 * (kind >= TRUNCATED), kind % TRUNCATED
                c = min(c, 3 + late + after[NEXT[s]])
                if (s, initial) in KEEP:
                    c = min(c, late + after[KEEP[s, initial]])
            costs.append(c)
        for _ in range(3):
            costs = [min(c, 3 + costs[NEXT[s]]) for s, c in enumerate(costs)]
        least = min(costs)
        found = _steps[after, kind] = tuple(c - least for c in costs), least
    return found


def backward(kinds: bytes, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    total = 0
    for kind in reversed(kinds):
        after, c = step(after, kind)
        total += c
    return after, total


def trace(kinds: bytes, after: tuple[int, ...], start: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """The cheapest, ASCII-least edits (letter, row, state before it) from ``start``, and the last state."""
    vectors = [(after, 0)]
    for kind in reversed(kinds):
        vectors.append(step(vectors[-1][0], kind))
    vectors.reverse()
    edits, s = [], start
    for i, kind in enumerate(kinds):
        now, const = vectors[i]
        then = vectors[i + 1][0]
        while True:
            if 4 + then[s] == now[s] + const:
                edits.append(("D", i, s))
                break
            if 3 + now[NEXT[s]] == now[s]:
                edits.append(("I", i, s))
                s = NEXT[s]
                continue
            to = KEEP.get((s, kind % TRUNCATED))
            if to is not None and 3 * (kind >= TRUNCATED) + then[to] == now[s] + const:
                edits.append(("K", i, s))
                s = to
            else:
                edits.append(("R", i, s))
                s = NEXT[s]
            break
    while last and s not in (0, 3):
        edits.append(("I", len(kinds), s))
        s = NEXT[s]
    return edits, s


def row_code(role: str, text: str) -> int:
    """Initial of the role, and whether the row is blank or truncated."""
    left = text.rstrip(SPACE)
    initial = {"u": 0, "a": 1, "s": 2}.get(role[:1], OTHER)
    return initial + (BLANK if not left else TRUNCATED if left[-1] not in ".!?" else 0)


def kinds_of(codes: bytes, digests: bytes, earlier: set[bytes]) -> tuple[bytes, list[int]]:
    """What Viterbi needs to know of each row; the numbers of blank, duplicate, truncated rows and of illegal neighbours."""
    seen, kinds, n = set(earlier), bytearray(), [0, 0, 0, 0]
    for i, code in enumerate(codes):
        initial, d = code % TRUNCATED, digests[16 * i : 16 * i + 16]
        if code >= BLANK:
            n[0] += 1
            kinds.append(initial + FORCED)
        elif d in seen:
            n[1] += 1
            kinds.append(initial + FORCED)
        else:
            n[2] += code >= TRUNCATED
            kinds.append(code)
        seen.add(d)
        n[3] += i > 0 and (codes[i - 1] % TRUNCATED, initial) not in LEGAL
    return bytes(kinds), n


def repaired(edits: list[tuple[str, int, int]], roles: list[str], texts: list[str]) -> list[str]:
    out = []
    for letter, i, s in edits:
        if letter == "I":
            out.append(f"{ROLE[s]}:")
        elif letter != "D":
            out.append(f"{roles[i] if letter == 'K' else ROLE[s]}:{texts[i]}")
    return out


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


class _Chunk:
    """Rows of one conversation in one task, in order."""

    def __init__(self) -> None:
        self.codes, self.digests, self.roles, self.texts = bytearray(), bytearray(), [], []
        self.first = self.last = None
        self.turns = self.bytes = 0

    def add(self, turn, role: str, text: str, digest: bytes) -> None:
        self.codes.append(row_code(role, text))
        self.digests += digest
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn


def result_fields(key: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]


def _chunks(rows: DataFrame, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Sorted rows as chunks, and the results of conversations that end where they began."""
    key = rows.schema["conv"].dataType
    done = result_fields("conv", key)
    schema = T.StructType([T.StructField("cid", T.StringType()), *done, T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("codes", "digests")], *[T.StructField(c, T.LongType()) for c in ("first_turn", "last_turn", "turns")],
                           *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("roles", "texts")]])
    names = schema.fieldNames()
    blank = dict.fromkeys(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        cid = conv = None
        chunk, seq, first, out, size = _Chunk(), 0, True, [], 0

        def opened() -> dict:
            return blank | {"cid": cid, "conv": conv, "part": part, "seq": seq, "codes": bytes(chunk.codes), "digests": bytes(chunk.digests), "first_turn": chunk.first,
                            "last_turn": chunk.last, "turns": chunk.turns, "roles": chunk.roles, "texts": chunk.texts}

        def closed() -> dict:
            kinds, n = kinds_of(bytes(chunk.codes), bytes(chunk.digests), set())
            vector, cost = backward(kinds, END)
            edits, _ = trace(kinds, END, 0, True)
            gaps = chunk.last - chunk.first + 1 - chunk.turns if chunk.turns else 0
            return blank | dict(zip(("cid", "conv", "gaps", "blank", "duplicate", "truncated", "illegal"), (cid, conv, gaps, *n))) | {
                "cost": cost + vector[0], "audit": "".join(e[0] for e in edits), "repaired_sha256": _sha(repaired(edits, chunk.roles, chunk.texts))}

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cid", "conv", "turn", "role", "text", "gone", "digest")]
            for own, of, turn, role, text, gone, digest in zip(*columns):
                if own != cid:
                    if cid is not None:
                        out.append(opened() if first or seq else closed())
                        first = False
                    cid, conv, chunk, seq = own, of, _Chunk(), 0
                elif len(chunk.codes) >= chunk_rows or chunk.bytes >= chunk_bytes:
                    if not gone:
                        out.append(opened())
                        size += chunk.bytes
                        chunk, seq = _Chunk(), seq + 1
                if not gone:
                    chunk.add(turn, role, text, digest)
                if len(out) >= 1000 or size >= 8 * chunk_bytes:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if cid is not None:
            out.append(opened())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def _mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """Each row (as a dict) through ``fn``, which yields rows; row-local."""
    parsed = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(parsed)
        for batch in batches:
            for i in range(0, len(batch), 256):
                out = [x for row in batch.slice(i, 256).to_pylist() for x in fn(row)]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, parsed)


def _indexed(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Narrow rows of the chunks with text, numbered from 0 in each conversation."""
    narrow = written(spark, chunks.where("length(codes) > 0").select("cid", "part", "seq", "codes", "digests", "first_turn", "last_turn", "turns"), "chunks")
    per_part = narrow.groupBy("cid", "part").agg(F.count("*").alias("n"))  # one row a task that the conversation reaches
    before = Window.partitionBy("cid").orderBy("part")
    base = per_part.select("cid", "part", (F.sum("n").over(before) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("cid")).alias("chunks"))
    return narrow.join(base, ["cid", "part"]).withColumn("idx", F.col("base") + F.col("seq")).drop("base")


def _later(numbered: DataFrame) -> DataFrame:
    """(cid, idx, earlier): the digests of a chunk that an earlier chunk of its conversation has."""

    def digests(row: dict) -> Iterator[dict]:
        d, codes = row["digests"], row["codes"]
        for x in {d[16 * i : 16 * i + 16] for i, c in enumerate(codes) if c < BLANK}:
            yield {"cid": row["cid"], "idx": row["idx"], "d": x}

    entries = _mapped(numbered.where("chunks > 1").select("cid", "idx", "codes", "digests"), digests, "cid string, idx long, d binary")
    first = entries.groupBy("cid", "d").agg(F.min("idx").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return entries.join(first, ["cid", "d"]).where("idx > first").groupBy("cid", "idx").agg(F.collect_list("d").alias("earlier"))


def _speculative(marked: DataFrame) -> DataFrame:
    def run(row: dict) -> Iterator[dict]:
        kinds, n = kinds_of(row["codes"], row["digests"], set(row["earlier"] or ()))
        vector, cost = backward(kinds, END)
        yield row | {"kinds": kinds, "blank": n[0], "duplicate": n[1], "truncated": n[2], "illegal": n[3], "head": row["codes"][0] % TRUNCATED, "tail": row["codes"][-1] % TRUNCATED,
                     "after": bytes(END), "before": bytes(vector), "cost": cost}

    return _mapped(marked, run, "cid string, part int, seq long, idx long, chunks long, first_turn long, last_turn long, turns long, kinds binary, "
                   "blank long, duplicate long, truncated long, illegal long, head int, tail int, after binary, before binary, cost long")


def _with_next(chunks: DataFrame) -> DataFrame:
    follower = chunks.select("cid", (F.col("idx") - 1).alias("idx"), F.col("before").alias("wanted"), F.col("head").alias("next_head"), F.col("first_turn").alias("next_turn"))
    return chunks.join(follower, ["cid", "idx"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(bytearray(END))))


def stitched(spark: SparkSession, chunks: DataFrame, passes: list | None = None) -> DataFrame:
    """Fix-up passes until each chunk ran from the vector that its follower has now.

    ``passes``, where given, receives the number of chunks that were to be run again in each pass."""
    chunks, width = written(spark, chunks, "vectors"), 1
    while True:
        stale = _with_next(chunks).where("after <> wanted").count()
        if passes is not None:
            passes.append(stale)
        if not stale:
            return chunks
        width *= WIDER
        fields = chunks.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow, at, vector = to_arrow_schema(fields), None, None
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    group = row["cid"], row["idx"] // width
                    wanted = row.pop("wanted") if group != at else vector
                    if wanted != row["after"]:
                        before, cost = backward(row["kinds"], tuple(wanted))
                        row |= {"after": wanted, "before": bytes(before), "cost": cost}
                    at, vector = group, row["before"]
                    out.append({c: row[c] for c in fields.names})
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        dealt = (_with_next(chunks).drop("next_head", "next_turn").withColumn("_group", F.expr(f"idx div {width}")).repartition("cid", "_group")
                 .sortWithinPartitions("cid", "_group", F.desc("idx")).drop("_group"))
        chunks = written(spark, dealt.mapInArrow(run, fields), "vectors")


def _starts(spark: SparkSession, maps: DataFrame, group: int = GROUP) -> DataFrame:
    """(cid, idx, start): of each chunk the composition of the maps of all earlier ones, in two or more levels."""

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        now, out = bytes(range(4)), []
        for f in rows.column("map").to_pylist():
            out.append(now)
            now = bytes(f[x] for x in now)
        return pa.table([rows.column("cid"), rows.column("g"), rows.column("idx"), pa.array(out, pa.binary()), pa.array([now] * len(out), pa.binary())], names=["cid", "g", "idx", "start", "whole"])

    inner = maps.withColumn("g", F.expr(f"idx div {group}")).groupBy("cid", "g").applyInArrow(compose, "cid string, g long, idx long, start binary, whole binary")
    inner = written(spark, inner, "maps")
    if inner.where("g > 0").isEmpty():
        return inner.select("cid", "idx", "start")
    outer = _starts(spark, inner.select("cid", F.col("g").alias("idx"), F.col("whole").alias("map")).distinct(), group)
    both = inner.select("cid", "g", "idx", "start").join(outer.select("cid", F.col("idx").alias("g"), F.col("start").alias("outer")), ["cid", "g"])

    def apply(row: dict) -> Iterator[dict]:
        yield {"cid": row["cid"], "idx": row["idx"], "start": bytes(row["start"][x] for x in row["outer"])}

    return _mapped(both.select("cid", "idx", "start", "outer"), apply, "cid string, idx long, start binary")


def _long_results(spark: SparkSession, opened: DataFrame, group: int, passes: list | None) -> DataFrame:
    """Results of conversations of several chunks, or of more than one task."""
    kind = opened.schema["conv"].dataType
    numbered = written(spark, _indexed(spark, opened), "numbered")
    later = written(spark, _later(numbered), "later")
    chunks = stitched(spark, _speculative(numbered.join(later, ["cid", "idx"], "left")), passes)

    def maps(row: dict) -> Iterator[dict]:
        last = row["idx"] == row["chunks"] - 1
        yield {"cid": row["cid"], "idx": row["idx"], "map": bytes(trace(row["kinds"], tuple(row["after"]), s, last)[1] for s in range(4))}

    starts = _starts(spark, _mapped(chunks.select("cid", "idx", "chunks", "kinds", "after"), maps, "cid string, idx long, map binary"), group)
    texts = opened.where("length(codes) > 0").select("cid", "part", "seq", "roles", "texts")
    full = texts.join(chunks.select("cid", "part", "seq", "idx", "chunks", "kinds", "after"), ["cid", "part", "seq"]).join(starts, ["cid", "idx"])

    def traced(row: dict) -> Iterator[dict]:
        edits, _ = trace(row["kinds"], tuple(row["after"]), row["start"][0], row["idx"] == row["chunks"] - 1)
        lines = repaired(edits, row["roles"], row["texts"])
        yield {"cid": row["cid"], "idx": row["idx"], "audit": "".join(e[0] for e in edits), "lines": len(lines), "text": "\n".join(lines)}

    pieces = _mapped(full, traced, "cid string, idx long, audit string, lines int, text string")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, audit, sha, some = None, [], None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["cid"] != at:
                    if at is not None:
                        out.append((at, "".join(audit), sha.hexdigest()))
                    at, audit, sha, some = row["cid"], [], hashlib.sha256(), False
                audit.append(row["audit"])
                if row["lines"]:
                    sha.update(("\n" if some else "").encode() + row["text"].encode())
                    some = True
            yield _rows(out)
        if at is not None:
            yield _rows([(at, "".join(audit), sha.hexdigest())])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in out], pa.string()) for i in range(3)], names=["cid", "audit", "repaired_sha256"])

    ended = pieces.repartition("cid").sortWithinPartitions("cid", "idx").mapInArrow(joined, "cid string, audit string, repaired_sha256 string")

    legal = F.array(*[F.lit(a * 4 + b) for a, b in sorted(LEGAL)])
    at = _with_next(chunks)
    border = F.col("next_head").isNotNull() & ~F.array_contains(legal, F.col("tail") * 4 + F.col("next_head"))
    same = F.coalesce(F.col("last_turn") == F.col("next_turn"), F.lit(False))
    first = F.max(F.when(F.col("idx") == 0, F.conv(F.hex(F.substring("before", 1, 1)), 16, 10).cast("long")))
    distinct = F.sum("turns") - F.sum(same.cast("long"))
    totals = at.groupBy("cid").agg(F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - distinct, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
                                   (F.sum("illegal") + F.sum(border.cast("long"))).alias("illegal"), (F.sum("cost") + first).alias("cost"))
    ids = opened.groupBy("cid").agg(F.max("conv").alias("conv"))
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return ids.join(totals, "cid", "left").join(ended, "cid", "left").fillna(zeros, subset=list(zeros)).select(*[f.name for f in result_fields("conv", kind)])


def repair(spark: SparkSession, rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, group: int = GROUP, passes: list | None = None) -> DataFrame:
    """One row a conversation of ``rows`` (conv, turn, role, text, gone): conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. Rows that are ``gone`` only name their conversation."""
    body = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(body, 256)), 1, 16)
    cid = F.when(F.col("conv").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    # equal rows may lie in several ranges: their own numbers part them
    keyed = rows.select(cid.alias("cid"), "conv", F.col("turn").cast("long").alias("turn"), "role", "text", "gone", digest.alias("digest"), F.monotonically_increasing_id().alias("_n"))
    order = ["cid", "turn", "digest", "_n"]
    chunks = written(spark, _chunks(keyed.repartitionByRange(*order).sortWithinPartitions(*order), chunk_rows, chunk_bytes), "conversations")
    names = [f.name for f in result_fields("conv", rows.schema["conv"].dataType)]
    return chunks.where("part is null").select(*names).union(_long_results(spark, chunks.where("part is not null"), group, passes).select(*names))


def damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults, by ``crc32("key:turn") % 20``: 0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it,
    4 makes its role user. A null reads as one space. Dropped rows stay as ``gone`` rows without text."""

    def space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(space(key), F.lit(":"), space(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), space(role).alias("_role"), space(text).alias("_text"), fault.alias("_fault"))
    gone = F.col("_fault") == 0
    new_text = F.when(gone | (F.col("_fault") == 1), F.lit("")).when(F.col("_fault") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    new_role = F.when(gone, F.lit("")).when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("_role"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", new_role.alias("role"), new_text.alias("text"), gone.alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def repaired_conversations(spark: SparkSession, conversations: DataFrame, key: str = "conv_id", **options) -> DataFrame:
    """The damaged conversations, repaired: one row for every ``key``."""
    return repair(spark, damaged(conversations, key), **options).withColumnRenamed("conv", key)


def oracle_sql(table: str = "conversations") -> str:
    """A plain row-by-row programme over all conversations at once: for each state the least (cost, audit, text)."""
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce("
           "list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)")
    crc = crc.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    late = "(CASE WHEN truncated THEN 3 ELSE 0 END)"
    line = "CASE WHEN {0} = '' THEN '' ELSE {0} || chr(10) END"  # text so far
    inf = "struct_pack(c := 1000000000::BIGINT, a := '~', t := '')"

    def insert(s: str, role: str) -> str:
        return f"struct_pack(c := {s}.c + 3, a := {s}.a || 'I', t := {line.format(s + '.t')} || '{role}:')"

    def delete(s: str) -> str:
        return f"struct_pack(c := {s}.c + 4, a := {s}.a || 'D', t := {s}.t)"

    def rerole(s: str, role: str) -> str:
        return f"CASE WHEN forced THEN {inf} ELSE struct_pack(c := {s}.c + 3 + {late}, a := {s}.a || 'R', t := {line.format(s + '.t')} || '{role}:' || text) END"

    def keep(s: str, initial: str) -> str:
        return f"CASE WHEN forced OR initial <> '{initial}' THEN {inf} ELSE struct_pack(c := {s}.c + {late}, a := {s}.a || 'K', t := {line.format(s + '.t')} || role || ':' || text) END"

    # states before inserts: p0..p3; inserts lead to 2 and 3 only, from 0, 1, 3 to 2 and from 2 to 3
    close = f"""
  SELECT conv_id, i, p0 AS s0, p1 AS s1, least(p2, {insert('p0', 'user')}, {insert('p1', 'user')}, {insert('p3', 'user')}) AS s2, least(p3, {insert(
        f"least(p2, {insert('p0', 'user')}, {insert('p1', 'user')})", 'assistant')}) AS s3"""
    return f"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS f FROM {table}),
dam AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM src WHERE f <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i,
        rtrim(text, {space}) AS body, left(role, 1) AS initial FROM dam),
dup AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM ord),
r AS (SELECT conv_id, turn, role, text, initial, prev, i, body = '' AS blank, body <> '' AND seen AS duplicate,
      body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, body = '' OR seen AS forced FROM dup),
tot AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
        count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE i > 1 AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY 1),
go AS (
  {close.replace('i, p0', '0::BIGINT AS i, p0', 1)} FROM (SELECT conv_id, struct_pack(c := 0::BIGINT, a := '', t := '') AS p0, {inf} AS p1, {inf} AS p2, {inf} AS p3 FROM tot)
  UNION ALL
  {close} FROM (
    SELECT g.conv_id, r.i, {delete('s0')} AS p0,
      least({delete('s1')}, {keep('s0', 's')}) AS p1,
      least({delete('s2')}, {keep('s0', 'u')}, {keep('s1', 'u')}, {keep('s3', 'u')}, {rerole('s0', 'user')}, {rerole('s1', 'user')}, {rerole('s3', 'user')}) AS p2,
      least({delete('s3')}, {keep('s2', 'a')}, {rerole('s2', 'assistant')}) AS p3
    FROM go g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i + 1)),
best AS (SELECT g.conv_id, least(s0, s3) AS b FROM go g JOIN tot ON tot.conv_id IS NOT DISTINCT FROM g.conv_id AND tot.n = g.i)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {table}) o LEFT JOIN tot ON tot.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id"""
