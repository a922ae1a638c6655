"""Conversation repair against a row-by-row programme over whole conversations, and its edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from tessera.llm import conversation_repair as C

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
WHITE = " \t\n\x0b\x0c\r"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    """{conv_id: result} by a plain forward programme that keeps the least (cost, audit, lines) of each state."""
    by = {}
    for conv, turn, role, text in rows:
        mark = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(mark.encode()) % 20
        mine = by.setdefault(conv, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        seen, blank, dup, cut, forced, late = set(), 0, 0, 0, [], []
        for _, role, text in mine:
            body = text.strip(WHITE)
            kind = "blank" if not body else "dup" if (role, text) in seen else "cut" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, dup, cut = blank + (kind == "blank"), dup + (kind == "dup"), cut + (kind == "cut")
            forced.append(kind in ("blank", "dup"))
            late.append(3 * (kind == "cut"))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        now = {"": (0, "", ())}  # last initial: best

        def inserted(now):
            for _ in range(3):
                for s, (c, a, lines) in list(now.items()):
                    role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[s]
                    new = (c + 3, a + "I", lines + (role + ":",))
                    if role[0] not in now or new < now[role[0]]:
                        now[role[0]] = new
            return now

        now = inserted(now)
        for (_, role, text), f, x in zip(mine, forced, late):
            then = {}

            def offer(s, new):
                if s not in then or new < then[s]:
                    then[s] = new

            for s, (c, a, lines) in now.items():
                offer(s, (c + 4, a + "D", lines))
                if not f:
                    want = {"": "us", "s": "u", "u": "a", "a": "u"}[s]
                    if role[:1] and role[:1] in want:
                        offer(role[:1], (c + x, a + "K", lines + (f"{role}:{text}",)))
                    to = "assistant" if want == "a" else "user"
                    offer(to[0], (c + 3 + x, a + "R", lines + (f"{to}:{text}",)))
            now = inserted(then)
        cost, audit, lines = min(now[s] for s in ("", "a") if s in now)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((p + q) not in ("su", "ua", "au") for p, q in zip(initials, initials[1:]))
        out[conv] = (gaps, blank, dup, cut, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    res = C.repaired_conversations(spark, df, **options).collect()
    found = {r.conv_id: tuple(r)[1:] for r in res}
    assert len(found) == len(res)
    return found


def invented(seed, convs, longest, roles=("user", "assistant", "system", "tool", "", None)):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.randrange(longest)):
            role = r.choice(roles) if r.random() < 0.4 else roles[t % 2]
            text = r.choice(["Yes.", "no", "  ", "", "Why?\n", "ok!\t", "Then so.", None]) if r.random() < 0.6 else f"line {t}."
            rows.append((c, None if r.random() < 0.05 else t + (r.random() < 0.1), role, text))
    return rows


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3, "group": 2}, {"chunk_bytes": 12, "group": 4}])
def test_equals_row_by_row(spark, options):
    rows = invented(len(options), [*range(30), None], 40) + invented(7, [-5], 200)
    assert got(spark, rows, **options) == brute(rows)


def test_vectors_that_never_meet(spark):
    """Rows that only Rerole or Delete fit, after which vectors differ by the parity of the rows for ever."""
    rows = [(1, t, "tool" if t > 3 else "assistant", f"text {t}.") for t in range(400)]
    passes = []
    assert got(spark, rows, chunk_rows=2, group=4, passes=passes) == brute(rows)
    assert passes[-1] == 0 and len(passes) <= 4


def test_hot_conversation_of_equal_rows(spark):
    rows = [(9, 4, "user", "the same."), (9, 5, "assistant", "reply.")] + [(9, 8, "user", "again and again.")] * 900 + [(9, None, "system", "Be.")]
    assert got(spark, rows, chunk_rows=16) == brute(rows)


def test_edge_cases(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone."), (2000, None, None, None), (2001, 3, "user", "x" * 300_000 + "."), (2001, 4, "assistant", "ü" * 50_000), (None, 1, "user", "no id.")]
    want = brute(rows)
    assert want[dropped][-2:] == ("", hashlib.sha256().hexdigest())
    assert got(spark, rows) == want
    assert got(spark, []) == {}


def test_clashing_columns(spark):
    rows = [(1, t, r, f"words {t}.", "x", "y", 5) for t, r in enumerate(["user", "assistant"] * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, cid string, part int")
    res = C.repaired_conversations(spark, df).collect()
    assert {r.conv_id: tuple(r)[1:] for r in res} == brute([r[:4] for r in rows])


def test_steps_agree_with_the_audit():
    """From every state the traced edits cost what the vector says."""
    r = random.Random(3)
    for _ in range(300):
        kinds = bytes(r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) for _ in range(r.randrange(12)))
        vector, total = C.backward(kinds, C.END)
        for s in range(4):
            edits, _ = C.trace(kinds, C.END, s, True)
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] + 3 * (x in "KR" and 4 <= kinds[i] < 8) for x, i, _ in edits)
            assert cost == vector[s] + total
