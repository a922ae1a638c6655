"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Every adjacent pair of symbols that together make a piece stands on an agenda ordered by the
piece's score, ties by place from the left. The head of the agenda is merged, the pairs beside it
are scored anew, until the agenda is empty. Characters without a piece fall back to their bytes.

No piece of a supported vocabulary has a space mark after another character (checked when the model
is read), so merges never leave a segment: a run of spaces and what follows it. The agendas of all
distinct segments of a block advance together, one merge of each in a NumPy round; a segment of more
than ``LONG`` characters has a heap of its own, in O(n log n). Segments new to a task are also
encoded by the ``sentencepiece`` library, in batches; where the two differ the library's ids are
taken and counted in ``n_corrected``.

Null or empty text: begin and end ids only, decoded as the empty text. Repeated rows give repeated
results, an empty table an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytewords as B

MARK = "▁"
LONG = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """A merge-type vocabulary: which pairs of symbols merge, to what, and in which order."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = np.array([p.type for p in proto.pieces])
        texts = [p.piece for p in proto.pieces]
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("text must be taken as it is, with a space put before it")
        if np.isin(kinds, (USER, UNUSED)).any() or any(MARK in t.lstrip(MARK) for t in texts):
            raise ValueError("user-defined, unused or space-spanning pieces aren't supported")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.n = len(texts)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.of_byte = np.full(256, -1, dtype=np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.of_byte[int(texts[i][1:-1], 16)] = i

        normal = [i for i in range(self.n) if kinds[i] == NORMAL]
        symbol = {texts[i]: i for i in normal}
        for i in normal:  # a character that only longer pieces have is a symbol, but no piece
            for c in texts[i]:
                symbol.setdefault(c, len(symbol) + self.n)
        self.other = max(symbol.values()) + 1  # any character that no piece has
        self.of_char = np.full(0x110000, self.other, dtype=np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        rank = {s: r for r, s in enumerate(sorted({proto.pieces[i].score for i in normal}))}
        pairs = {}
        for i in normal:
            t = texts[i]
            for c in range(1, len(t)):
                left, right = symbol.get(t[:c]), symbol.get(t[c:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (i, rank[proto.pieces[i].score])
        self._bits = max(8, (2 * len(pairs)).bit_length())
        self._keys = np.full((1 << self._bits) + 64, -1, dtype=np.int64)
        self._to = np.zeros(len(self._keys), dtype=np.int32)
        self._rank = np.full(len(self._keys), -1, dtype=np.int32)
        slots = self._slot(np.array(list(pairs), dtype=np.int64))
        for (key, (to, r)), slot in zip(pairs.items(), slots.tolist()):
            while self._keys[slot] != -1:
                slot += 1
            self._keys[slot], self._to[slot], self._rank[slot] = key, to, r
        self._merge = np.where(self._rank < 0, -1, self._rank.astype(np.int64) << 40 | self._to)

        plain = [b"" if k == CONTROL else bytes([int(t[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else t.replace(MARK, " ").encode()
                 for t, k in zip(texts, kinds)]
        self.kinds = kinds
        self.length = np.array([len(x) for x in plain])
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.plain = np.frombuffer(b"".join(plain), dtype=np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def one_pair(self, left: int, right: int) -> tuple[int, int]:
        """(result, rank) of one pair; rank -1: no merge."""
        key = left << 32 | right
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self._bits)
        while self._keys[slot] != key and self._keys[slot] != -1:
            slot += 1
        return int(self._to[slot]), int(self._rank[slot])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs in the merge table; an empty slot has rank -1."""
        keys = left << 32 | right
        slot = self._slot(keys)
        todo = np.flatnonzero((self._keys[slot] != keys) & (self._keys[slot] != -1))
        while len(todo):
            slot[todo] += 1
            now = self._keys[slot[todo]]
            todo = todo[(now != keys[todo]) & (now != -1)]
        return slot

    # encoding

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in a row, and how many each has."""
        return self.encode_chars(np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32), np.fromiter(map(len, segments), np.int64, len(segments)))

    def encode_chars(self, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of segments whose characters stand in a row; ``size``: how many each has."""
        symbol = self.of_char[chars].astype(np.int64)
        segment = np.repeat(np.arange(len(size)), size)
        long = size > LONG
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # place, symbol, segment
        place = np.arange(len(chars))
        if long.any():
            ends = np.cumsum(size)
            for s in np.flatnonzero(long):
                a, b = int(ends[s] - size[s]), int(ends[s])
                at, sym = self._heap(symbol[a:b].tolist())
                done.append((np.array(at) + a, np.array(sym), np.full(len(at), s)))
            keep = ~long[segment]
            symbol, segment, place = symbol[keep], segment[keep], place[keep]
        self._rounds(symbol, segment, place, done)
        place, symbol, segment = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.argsort(place)
        place, symbol, segment = place[order], symbol[order], segment[order]
        raw = symbol >= self.n
        if not raw.any():
            return symbol, np.bincount(segment, minlength=len(size))
        own = [self.of_byte[list(chr(c).encode())] for c in chars[place[raw]]]
        width = np.ones(len(symbol), dtype=np.int64)
        width[raw] = [len(x) for x in own]
        ids = np.repeat(symbol, width)
        ids[np.repeat(raw, width)] = np.concatenate(own)
        return ids, np.bincount(segment, weights=width, minlength=len(size)).astype(np.int64)

    def _merges(self, symbol: np.ndarray, tag: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the given ones that have a symbol of their segment after them, and the merges of these two:
        rank, how far left the place is, and result in one number; -1: no merge."""
        at = at[(at >= 0) & (at < len(symbol) - 1)]
        own = tag[at]
        inner = own >> 7 == tag[at + 1] >> 7
        at, own = at[inner], own[inner]
        return at, self._merge[self.pair(symbol[at], symbol[at + 1])] | (own & 127) << 32

    def _rounds(self, symbol: np.ndarray, segment: np.ndarray, place: np.ndarray, done: list) -> None:
        if not len(symbol):
            return
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        size = np.diff(np.concatenate((first, [len(symbol)])))
        begin = np.zeros(segment[-1] + 1, dtype=np.int64)  # of each segment, its first place
        begin[segment[first]] = place[first]
        tag = segment << 7 | LONG - (np.arange(len(symbol)) - np.repeat(first, size))  # the segment, and how far left in it
        merge = np.full(len(symbol), -1, dtype=np.int64)
        at, found = self._merges(symbol, tag, np.arange(len(symbol)))
        merge[at] = found
        while len(symbol):
            head = np.maximum.reduceat(merge, first)  # of each agenda: the highest rank, of these the leftmost
            live = head >= 0
            if not live.all():
                keep = np.repeat(live, size)
                ended = tag[~keep]
                done.append((begin[ended >> 7] + LONG - (ended & 127), symbol[~keep], ended >> 7))
                symbol, tag, merge, head, size = symbol[keep], tag[keep], merge[keep], head[live], size[live]
                if not len(symbol):
                    return
            left = np.flatnonzero(merge == np.repeat(head, size))
            symbol[left] = head & 0xFFFFFFFF
            keep = np.ones(len(symbol), dtype=bool)
            keep[left + 1] = False
            symbol, tag, merge = symbol[keep], tag[keep], merge[keep]
            size -= 1
            first = np.cumsum(size) - size
            left -= np.arange(len(left))  # as many symbols before it have gone
            touched = np.concatenate((left - 1, left))
            touched = touched[touched >= 0]
            merge[touched] = -1
            at, found = self._merges(symbol, tag, touched)
            merge[at] = found

    def _heap(self, symbol: list[int]) -> tuple[list[int], list[int]]:
        """The agenda of one long segment as a heap: places and symbols that remain."""
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            to, rank = self.one_pair(symbol[i], symbol[j])
            if rank >= 0:
                heapq.heappush(agenda, (-rank, i, symbol[i], symbol[j], to))

        for i in range(n - 1):
            push(i, i + 1)
        while agenda:
            _, i, left, right, to = heapq.heappop(agenda)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has merged meanwhile
            symbol[i], symbol[j] = to, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        left = [i for i in range(n) if symbol[i] != -1]
        return left, [symbol[i] for i in left]

    # decoding

    def decode_bytes(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids (``at``: where the runs begin, one more at the end)."""
        size = self.length[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        out = self.plain[np.arange(total[-1]) + np.repeat(self.start[ids] - total[:-1], size)].tobytes()
        texts = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            one = out[total[a] : total[b]]
            if one[:1] == b" ":  # the space that encoding has put before the text
                k = a
                while self.length[ids[k]] == 0:
                    k += 1
                one = one if self.kinds[ids[k]] == BYTE else one[1:]
            try:
                one.decode("utf-8")
            except UnicodeDecodeError:  # bytes that make no character: one mark for each, as the library does
                one = self.library.decode(ids[a:b].tolist()).encode("utf-8")
            texts.append(one)
        return texts


def without_marks(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with spaces for space marks; the given ones where they have none."""
    if b"\xe2\x96\x81" not in buf.tobytes():
        return buf, offsets
    rows = [buf[a:b].tobytes().replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1], offsets[1:])]
    return np.frombuffer(b"".join(rows), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts (after the space that each has), ends and hashes of all segments, and at which one each text begins (one more at the end)."""
    space = buf == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    filled = offsets[:-1][np.diff(offsets) > 0]
    begins[filled] = True
    starts = np.flatnonzero(begins)
    ends = np.concatenate((starts[1:], [len(buf)])) if len(starts) else starts
    fresh = np.zeros(len(buf) + 1, dtype=bool)
    fresh[filled] = True
    # the first segment of a text has one space more than its bytes show
    body = np.where(fresh[starts], starts, starts + 1)
    return body, ends, B.span_hashes(buf, body, ends), np.searchsorted(starts, offsets)


def segment_chars(buf: np.ndarray, body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of segments in a row and how many each has: a space mark, then the bytes from ``body`` to ``ends`` with marks for spaces."""
    n = ends - body
    total = np.concatenate(([0], np.cumsum(n)))
    raw = buf[np.arange(total[-1]) + np.repeat(body - total[:-1], n)]
    chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))[total]  # a character begins at each byte that continues none
    out = np.empty(len(chars) + len(n), dtype=np.uint32)
    inner = np.ones(len(out), dtype=bool)
    mark = first[:-1] + np.arange(len(n))
    inner[mark] = False
    out[mark], out[inner] = ord(MARK), np.where(chars == 0x20, ord(MARK), chars)
    return out, np.diff(first) + 1


class Encoder:
    """Encodes blocks of texts; keeps the ids of recent segments in a table of bounded size."""

    def __init__(self, model: bytes, check: bool = True, keep_ids: int = 1 << 22):
        self.pieces, self.check, self.keep = Pieces(model), check, keep_ids
        self.cache = B.SpanCache()
        self.ids, self.used = np.zeros(keep_ids, dtype=np.int32), 0

    def _new(self, buf: np.ndarray, body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, n = self.pieces.encode_chars(*segment_chars(buf, body, ends))
        wrong = np.zeros(len(body), dtype=np.int64)
        if self.check:  # the library puts the first space mark there itself, but not before nothing
            raw = buf.tobytes()
            segments = [MARK + raw[a:b].decode("utf-8").replace(" ", MARK) for a, b in zip(body, ends)]
            lone = [self.pieces.library.piece_to_id(MARK)]
            theirs = [x or lone for x in self.pieces.library.encode([s[1:].replace(MARK, " ") for s in segments], num_threads=1)]
            m = np.fromiter(map(len, theirs), np.int64, len(theirs))
            flat = np.fromiter((i for x in theirs for i in x), np.int64, int(m.sum()))
            if not np.array_equal(n, m) or not np.array_equal(ids, flat):
                own = np.split(ids, np.cumsum(n)[:-1])
                wrong[:] = [not np.array_equal(a, b) for a, b in zip(own, theirs)]
                ids, n = flat, m
        return ids, n, wrong

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, where each text's begin (one more at the end), corrections of each."""
        buf, offsets = without_marks(buf, offsets)
        return self.encode_spans(buf, *spans(buf, offsets))

    def encode_spans(self, buf: np.ndarray, body: np.ndarray, ends: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of texts whose segments have been found."""
        found, hit = self.cache.find(keys)
        if self.used > self.keep * 7 // 8:
            self.cache.clear()
            self.used, hit = 0, np.zeros(len(keys), dtype=bool)
        value = np.where(hit, found, 0)
        extra = None
        if not hit.all():
            missed = np.flatnonzero(~hit)
            new, first, back = np.unique(keys[missed], return_index=True, return_inverse=True)
            where = missed[first]
            ids, n, wrong = self._new(buf, body[where], ends[where])
            ptr = np.concatenate(([0], np.cumsum(n)[:-1]))
            if self.used + len(ids) > len(self.ids):  # for this block only; nothing of it is kept
                extra = np.concatenate((self.ids[: self.used], ids))
            else:
                self.ids[self.used : self.used + len(ids)] = ids
            word = (ptr + self.used) << 22 | np.minimum(n, (1 << 21) - 1) << 1 | wrong
            if (n >= (1 << 21) - 1).any() or extra is not None:
                return self._plain(value, missed, back, ptr + self.used, n, wrong, at, self.ids if extra is None else extra, len(ids))
            value[missed] = word[back]
            self.cache.put(new, word)
            self.used += len(ids)
        return self._gather(value >> 22, value >> 1 & ((1 << 21) - 1), value & 1, at, self.ids)

    def _plain(self, value, missed, back, ptr, n, wrong, at, ids, more):
        p, m, w = value >> 22, value >> 1 & ((1 << 21) - 1), value & 1
        p[missed], m[missed], w[missed] = ptr[back], n[back], wrong[back]
        return self._gather(p, m, w, at, ids)

    @staticmethod
    def _gather(ptr, n, wrong, at, ids):
        total = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.arange(total[-1]) + np.repeat(ptr - total[:-1], n)]
        bad = np.concatenate(([0], np.cumsum(wrong)))
        return out, total[at], bad[at[1:]] - bad[at[:-1]]


@lru_cache(maxsize=1)
def _encoder(model: bytes, check: bool) -> Encoder:
    """Kept between the tasks of a Python worker."""
    return Encoder(model, check)


def encode_decode(spark: SparkSession, docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text",
                  check: bool = True, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Of each row: key, ``n_tokens`` (with begin and end), ``ids_sha256`` (of little-endian 32-bit ids),
    ``decoded_sha256`` (of the decoded UTF-8), ``n_corrected``; on demand ``ids`` and ``decoded`` too."""
    shared = spark.sparkContext.broadcast(model)  # one vocabulary file
    B.batch_rows(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enc = _encoder(shared.value, check)
            buf, offsets = B.text_bytes(batch.column(1))
            for i, j in B.blocks(offsets):
                yield _digests(enc, batch.column(0).slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], with_ids, with_text)

    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType()), T.StructField("n_corrected", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("decoded", T.StringType())] * with_text
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, T.StructType(fields)).withColumnRenamed("key", key)


def _digests(enc: Encoder, keys: pa.Array, buf: np.ndarray, offsets: np.ndarray, with_ids: bool, with_text: bool) -> pa.RecordBatch:
    p = enc.pieces
    ids, at, fixed = enc.encode(buf, offsets)
    small = ids.astype("<u4")
    head, tail = (np.array([x], dtype="<u4").tobytes() for x in (p.bos, p.eos))
    digest = [hashlib.sha256(head + small[a:b].tobytes() + tail).hexdigest() for a, b in zip(at[:-1], at[1:])]
    texts = p.decode_bytes(ids, at)
    cols = [keys, pa.array(np.diff(at) + 2), pa.array(digest, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(fixed)]
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]
    if with_ids:
        rows = len(at) - 1
        full = np.empty(len(ids) + 2 * rows, dtype=np.int32)
        inner = np.ones(len(full), dtype=bool)
        begin, end = at[:-1] + 2 * np.arange(rows), at[1:] + 2 * np.arange(rows) + 1
        full[begin], full[end] = p.bos, p.eos
        inner[begin] = inner[end] = False
        full[inner] = ids
        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(full)])), pa.int32()), pa.array(full)))
        names.append("ids")
    if with_text:
        cols.append(pa.array(texts, pa.binary()).cast(pa.string()))
        names.append("decoded")
    return pa.record_batch(cols, names=names)
