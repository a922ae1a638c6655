"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Values are found by pattern and validated (Luhn for card numbers, remainder 97 for IBANs, calendar for
dates, octets for IPv4 addresses, issued areas for social security numbers, digit counts for phones).
Each becomes a number in the space of its own format and goes through a ten-round Feistel network
keyed by a secret; results outside the format walk on along the cycle. So a value keeps its length and
its validity, equal values get equal pseudonyms in all documents (whatever their punctuation or case), and
the holder of the key can undo it (``reveal``). Where numbers stand beside a value so that its pseudonym
would make a card of them, the pseudonym is the next one along its cycle; only there equal values may differ.

| kind | permuted | kept |
| --- | --- | --- |
| email | letters and digits before the last dot, as letters and digits | punctuation, case, top domain |
| card | all digits but the last, which is computed anew | grouping |
| iban | the account, class by class; check digits are computed anew | country, grouping |
| date | the day, within 1900-2099 | form of the date |
| ip | all octets, each within its count of digits | |
| phone | digits after the country code | punctuation, country code |
| ssn | all digits, within issued areas | punctuation |
| secret | letters and digits, class by class | known prefixes, length |

Null texts stay null, empty texts empty. Work on a row stays in that row: repeated rows give repeated
results, an empty table an empty result. All columns of the input stay; only the text changes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import bytewords as B

ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # to 2099-12-31


def permute(digits: list[int], bases: list[int], key: bytes, tag: str, undo: bool = False) -> list[int]:
    """A keyed permutation of the numbers with these digits in mixed bases."""
    half = (len(digits) + 1) // 2
    sizes = [prod(bases[:half]), prod(bases[half:])]
    parts = []
    for ds, bs in ((digits[:half], bases[:half]), (digits[half:], bases[half:])):
        n = 0
        for d, b in zip(ds, bs):
            n = n * b + d
        parts.append(n)
    head = f"{tag}|{sizes[0]}|{sizes[1]}|".encode()
    for i in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        side = i % 2
        size = sizes[side]
        width = size.bit_length() // 8 + 17
        f = int.from_bytes(hashlib.shake_256(key + head + f"{i}|{parts[1 - side]}".encode()).digest(width), "big")
        parts[side] = (parts[side] - f if undo else parts[side] + f) % size
    out = []
    for n, bs in zip(parts, (bases[:half], bases[half:])):
        ds = []
        for b in reversed(bs):
            n, d = divmod(n, b)
            ds.append(d)
        out += ds[::-1]
    return out


def walk(digits: list[int], bases: list[int], key: bytes, tag: str, undo: bool, valid: Callable[[list[int]], bool]) -> list[int]:
    """Go on along the cycle until the result is in the format; a permutation of the valid numbers."""
    digits = permute(digits, bases, key, tag, undo)
    while not valid(digits):
        digits = permute(digits, bases, key, tag, undo)
    return digits


def luhn(digits: list[int]) -> int:
    """What the check digit must add to these digits (without it)."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(text: str, digits: list[int]) -> str:
    """Put digits in the places of the digits of a text."""
    it = iter(digits)
    return "".join(str(next(it)) if c.isascii() and c.isdigit() else c for c in text)


def _numbers(text: str) -> list[int]:
    return [int(c) for c in text if c.isascii() and c.isdigit()]


def classes(text: str, key: bytes, tag: str, undo: bool) -> str:
    """Permute ASCII letters among letters and digits among digits; case and the rest stay."""
    places = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    bases = [10 if text[i].isdigit() else 26 for i in places]
    digits = [int(text[i]) if text[i].isdigit() else ord(text[i].lower()) - 97 for i in places]
    out = list(text)
    for i, d in zip(places, permute(digits, bases, key, tag, undo)):
        out[i] = str(d) if text[i].isdigit() else chr((65 if text[i].isupper() else 97) + d)
    return "".join(out)


def _email(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    head, dot, top = m.group().rpartition(".")
    return classes(head, key, "email", undo) + dot + top


_CHAIN = re.compile(r"(?<![\w.-])\d(?:[ -]?\d)*(?![\w-])", re.A)
_GROUPINGS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}


def _is_card(d: list[int]) -> bool:
    return any(d) and luhn(d[:-1]) == d[-1]


def _stretches(text: str, taken: list[tuple]) -> list[tuple[bool, int, int, int]]:
    """(unusual, start, -digits, end) of all stretches of whole digit groups, 13 to 19 digits, outside what is taken."""
    out = []
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 13:
            continue
        groups = [g.span() for g in re.compile(r"\d+", re.A).finditer(text, *chain.span())]
        other = [t for t in taken if t[0] < chain.end() and chain.start() < t[1]]
        for i, (a, _) in enumerate(groups):
            size = 0
            for j in range(i, len(groups)):
                b = groups[j][1]
                size += b - groups[j][0]
                if size > 19:
                    break
                if size >= 13 and not any(a < t[1] and t[0] < b for t in other):
                    usual = i == j or tuple(y - x for x, y in groups[i : j + 1]) in _GROUPINGS
                    out.append((not usual, a, -size, b))
    return out


def _cards(text: str, tries: list[tuple[bool, int, int, int]]) -> list[tuple[bool, int, int, int]]:
    """The stretches that are cards: first single runs and the usual groupings, then others, each by start and longest first."""
    full, found = set(), []
    for t in sorted(tries):
        if (t[1] not in full and t[3] - 1 not in full) and _is_card(_numbers(text[t[1] : t[3]])) and full.isdisjoint(range(t[1], t[3])):
            full.update(range(t[1], t[3]))
            found.append(t)
    return found


# characters of an IBAN by country, from its registry
_IBAN_SIZES = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE "
    "31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}
_IBAN_SHAPES = {n: re.compile(rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"\b", re.A) for n in set(_IBAN_SIZES.values())}


def _card(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    digits = _numbers(m.group())
    body = walk(digits[:-1], [10] * (len(digits) - 1), key, "card", undo, lambda d: any(d) and alone(_fill(m.group(), [*d, luhn(d)])))
    return _fill(m.group(), [*body, luhn(body)])


def _iban_rest(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    if m.group()[:2] in _IBAN_SIZES and len(m.group().replace(" ", "")) != _IBAN_SIZES[m.group()[:2]]:
        return None
    plain = m.group().replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or 98 - _iban_rest(country, account) != int(check):
        return None
    account = classes(account, key, "iban", undo)
    new = iter(f"{country}{98 - _iban_rest(country, account):02d}{account}")
    return "".join(" " if c == " " else next(new) for c in m.group())


def _date(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    parts = re.split(r"[-/.]", m.group())
    year_first = len(parts[0]) == 4
    numbers = [int(p) for p in parts]
    # day before month, unless only the other order is a date
    for y, mo, d in [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]:
        try:
            day = (date(numbers[y], numbers[mo], numbers[d]) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= day < DAYS:
            return None
        width, marks, month_first = [len(x) for x in parts], re.findall(r"[-/.]", m.group()), (y, mo, d) == (2, 0, 1)

        def form(n: int) -> str | None:
            new, out = FIRST_DAY + timedelta(days=n), [""] * 3
            out[y], out[mo], out[d] = str(new.year), str(new.month).zfill(width[mo]), str(new.day).zfill(width[d])
            if [len(x) for x in out] != width or month_first and new.day <= 12:
                return None  # another width, or another reading
            return out[0] + marks[0] + out[1] + marks[1] + out[2]

        # all forms with full fields have the same days, so they share one permutation
        tag = f"date{width[mo]}{width[d]}{month_first:d}"
        a, b = walk([day // 271, day % 271], [270, 271], key, tag, undo, lambda x: x[0] * 271 + x[1] < DAYS and (new := form(x[0] * 271 + x[1])) is not None and alone(new))
        return form(a * 271 + b)
    return None


def _ip(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    octets = m.group().split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    low, size = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}

    def form(numbers: list[int]) -> str:
        return ".".join(str(n + low[len(o)]) for n, o in zip(numbers, octets))

    return form(walk([int(o) - low[len(o)] for o in octets], [size[len(o)] for o in octets], key, "ip", undo, lambda d: alone(form(d))))


def _phone(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    code, rest = m.group("code") or "", m.group("rest") or m.group("plain")
    digits = _numbers(rest)
    if not 7 <= len(digits) <= 14:
        return None
    area = len(digits) == 10 and digits[0] >= 2  # an area code doesn't begin with 0 or 1
    return code + _fill(rest, walk(digits, [10] * len(digits), key, "phone", undo, lambda d: (len(d) == 10 and d[0] >= 2) == area and alone(code + _fill(rest, d))))


def _ssn(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    def valid(d: list[int]) -> bool:
        area = d[0] * 100 + d[1] * 10 + d[2]
        return 0 < area < 900 and area != 666 and d[3:5] != [0, 0] and d[5:] != [0] * 4

    digits = _numbers(m.group())
    return _fill(m.group(), walk(digits, [10] * 9, key, "ssn", undo, lambda d: valid(d) and alone(_fill(m.group(), d)))) if valid(digits) else None


def _secret(m: re.Match, key: bytes, undo: bool, alone: Callable[[str], bool]) -> str | None:
    a, b = m.span("value")
    return m.group()[: a - m.start()] + classes(m.group("value"), key, "secret", undo) + m.group()[b - m.start() :]


# country codes; none begins with another
_CODES = r"[017]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[035789]|9[679])\d"

# (kind, characters one of which a text must have, pattern, replacement); the earlier kind wins where two overlap
FINDERS: list[tuple[str, str, re.Pattern, Callable]] = [
    ("email", "@", re.compile(r"(?<![\w.+-])[A-Za-z0-9_][\w.%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", re.A), _email),
    ("secret", "=:", re.compile(r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth)\b[\"']?[ \t]*[=:][ \t]*[\"']?)(?P<value>[A-Za-z0-9+/_.~-]{6,})", re.A), _secret),
    ("secret", "A", re.compile(r"\b(?:AKIA|ASIA)(?P<value>[A-Z0-9]{16})\b", re.A), _secret),
    ("secret", "_-", re.compile(r"\b(?:gh[pousr]_|github_pat_|glpat-|sk[-_](?:live_|test_)?|pk_(?:live_|test_)?|xox[abprs]-)(?P<value>[A-Za-z0-9_-]{16,})", re.A), _secret),
    ("iban", "0123456789", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.A), _iban),
    ("card", "0123456789", _CHAIN, _card),
    ("date", "0123456789", re.compile(r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d)", re.A), _date),
    ("ip", "0123456789", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.A), _ip),
    ("ssn", "0123456789", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), _ssn),
    ("phone", "0123456789", re.compile(r"(?<![\w.+])(?:(?P<code>\+(?:" + _CODES + r")[ .-]?|1[ .-])(?P<rest>\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4})|(?P<plain>\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\4\d{4}))(?![\w-])", re.A), _phone),
]


def _ends(kind: str, pattern: re.Pattern, m: re.Match) -> Iterator[re.Match]:
    """A match and, where its length is not given by its form, the shorter ones from the same start."""
    if kind == "iban" and m.group()[:2] in _IBAN_SIZES:
        m = _IBAN_SHAPES[_IBAN_SIZES[m.group()[:2]]].match(m.string, m.start())
        if m:
            yield m
        return
    yield m
    if kind == "phone":
        for e in range(m.end() - 1, m.start(), -1):
            if m.string[e] in " ." and (short := pattern.match(m.string, m.start(), e)) and short.end() == e:
                yield short


def replace(text: str, key: bytes, undo: bool = False) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms (or, undoing, with the values), and how many of each kind."""
    # where values are, which hangs on nothing that a pseudonym changes
    taken: list[tuple[int, int, str, re.Match, Callable]] = []
    tries: list[tuple[bool, int, int, int]] = []
    cards: list[tuple[bool, int, int, int]] = []
    for kind, some, pattern, change in FINDERS:
        if not any(c in text for c in some):
            continue
        if kind == "card":
            tries = _stretches(text, taken)
            cards = _cards(text, tries)
            taken += [(t[1], t[3], kind, re.compile(".*", re.S).match(text, t[1], t[3]), change) for t in cards]
            tries.sort(key=lambda t: t[1])
            continue
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + 1  # if it is no value, one may begin later inside
            for m in _ends(kind, pattern, m):
                a, b = m.span()
                if not any(a < t[1] and t[0] < b for t in taken) and change(m, key, undo, lambda new: True) is not None:
                    taken.append((a, b, kind, m, change))
                    at = b
                    break
    if not taken:
        return text, {}
    starts, now, found = [t[1] for t in tries], list(text), {}
    for a, b, kind, m, change in reversed(taken) if undo else taken:
        # no stretch that is tried before those it overlaps may become a card
        near = tries[bisect_left(starts, a - 40) : bisect_left(starts, b)] if kind not in ("email", "secret", "iban") else []
        near = [t for t in near if t[3] > a and not any(c <= t for c in cards if c[1] < t[3] and t[1] < c[3])]

        def alone(new: str) -> bool:
            now[a:b] = new
            return not any(_is_card(_numbers("".join(now[t[1] : t[3]]))) for t in near)

        now[a:b] = change(m, key, undo, alone)
        found[kind] = found.get(kind, 0) + 1
    return "".join(now), found


def reveal(text: str, key: bytes) -> str:
    """The text with all pseudonyms undone."""
    return replace(text, key, undo=True)[0]


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with personal data of the text column replaced; on demand a column with the number of replacements."""
    place = docs.columns.index(text)
    B.batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, {}) if t is None else replace(t, key) for t in batch.column(place).to_pylist()]
            cols = list(batch.columns)
            cols[place] = pa.array([d[0] for d in done], pa.string())
            if count:
                cols.append(pa.array([sum(d[1].values()) for d in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    names = [*docs.columns, *([count] if count else [])]
    types = [f.dataType for f in docs.schema.fields] + [T.LongType()] * bool(count)
    schema = T.StructType([T.StructField(f"c{i}", t) for i, t in enumerate(types)])
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*names)
