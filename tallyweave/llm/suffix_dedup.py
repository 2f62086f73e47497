"""Exact substring deduplication across documents by suffix arrays.

Every 50-byte string holds one anchor, the smallest hash among its 24-byte strings, and equal strings hold equal
anchors at equal places. So documents need not be sorted as one text:

1. Documents are packed into compressed blocks, once, in a table bucketed by block: later steps read it in place.
2. Each block sends the hashes of its anchors, 5 bytes each, to the hash's bucket, and gets two bits for each: whether
   the anchor also occurs in another document, and whether it is hot, that is, has very many different texts.
3. For shared anchors the block sends the text around them, each distinct text once with its smallest doc_id. A hot
   anchor's text is sent as its 50-byte strings, each to the bucket of its own hash, so that no anchor is one task's.
   In a bucket the texts around each anchor are joined and suffix-sorted, a text that many documents have as one range
   of suffixes; suffixes that share 50 bytes are neighbours, and those that a smaller doc_id also has are answered.
4. Each block marks the bytes that these strings cover.

Hashes only bring texts together: those that count as equal are compared byte by byte.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import give_back, remove, small_batches, stage, staged_path, tidy
from .suffix_array import ragged, sort_many, sort_suffixes

LENGTH, GRAM = 50, 24
BLOCK_BYTES = 1_000_000
STRETCH = 1 << 15
BUCKET_KEYS = 300_000  # anchors of a bucket, about
LONG_TEXT = 3000  # texts that are sorted alone rather than in step
HOT_ANCHOR = 5_000  # different texts (by block) from which an anchor's strings are dealt out one by one
OFTEN = 16  # texts in a block from which the block tells their number
SPAN = 1 << 22  # bytes whose prefix sums are kept at once
COMPARED = 20_000  # texts whose bytes are compared at once
WIDEST = 80  # bytes that hold any text around an anchor
BUCKET_BYTES, LEAST_BYTES = 64_000_000, 4_000_000  # input bytes of a bucket of blocks, and fewest where tasks are wanting
_PLACE = np.uint64((1 << 28) - 1)  # places are within a stretch
_LOW = np.uint64((1 << 40) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _words(raw: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each place on as a number; ``raw`` has 8 bytes more than ``n``."""
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(raw, shape=(n, 8), strides=(1, 1))).view("<u8").ravel()


class Block:
    """Documents as one run of bytes, with the anchors of all strings of 50 bytes that lie within a document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, carried: bytes):
        self.ids, self.sizes, self.data, self.carried = ids, sizes, data, carried
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.place = self.first = self.last = self.doc = np.zeros(0, dtype=np.int64)
        self.hash = np.zeros(0, dtype=np.uint64)
        n = len(data)
        if n >= LENGTH:
            self._anchors(n)

    def _anchors(self, n: int) -> None:
        raw = np.frombuffer(self.data + b"\0" * 8, dtype=np.uint8)
        long = self.sizes >= LENGTH
        change = np.zeros(n + 1, dtype=np.int8)
        np.add.at(change, self.starts[long], 1)
        np.add.at(change, self.starts[long] + self.sizes[long] - LENGTH + 1, -1)
        width, runs = LENGTH - GRAM + 1, []  # 27 places of a gram
        depth = 0
        for at in range(0, n - LENGTH + 1, STRETCH):  # short stretches stay in the processor's cache
            m = min(STRETCH, n - LENGTH + 1 - at)
            w = _words(raw[at:], m + LENGTH - 8)
            k = m + width - 1
            x, y, z = w[:k], w[8 : k + 8], w[16 : k + 16]
            h = _mix(x * _ODD[0] + (y ^ (x >> np.uint64(29))) * _ODD[1] + (z ^ (y >> np.uint64(31))) * _ODD[2])
            low = (h & ~_PLACE) | np.arange(k, dtype=np.uint64)
            for step in (1, 2, 4, 8):
                low = np.minimum(low[:-step], low[step:])
            low = np.minimum(low[:m], low[width - 16 :])
            inside = np.cumsum(change[at : at + m], dtype=np.int32) + depth
            depth = int(inside[-1])
            first = np.flatnonzero(inside > 0)
            if not len(first):
                continue
            place = (low[first] & _PLACE).astype(np.int64)
            new = np.ones(len(place), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
            head = np.flatnonzero(new)
            runs.append((place[head] + at, first[head] + at, first[np.append(head[1:] - 1, len(first) - 1)] + at, h[place[head]]))
        if not runs:
            return
        self.place, self.first, last, self.hash = (np.concatenate(c) for c in zip(*runs, strict=True))
        new = np.ones(len(last), dtype=bool)
        new[1:] = (self.place[1:] != self.place[:-1]) | (self.first[1:] != last[:-1] + 1)
        head = np.flatnonzero(new)  # a run goes on in the next stretch
        self.place, self.first, self.hash, self.last = self.place[head], self.first[head], self.hash[head], last[np.append(head[1:] - 1, len(last) - 1)]
        self.doc = np.searchsorted(self.starts + self.sizes, self.first, side="right")


def pack_block(ids: list[int], data: list[bytes], carried: bytes) -> bytes:
    import zstandard

    head = np.array([len(ids), *ids, *map(len, data)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(data) + carried)


def unpack_block(blob: bytes) -> Block:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    head = np.frombuffer(raw, dtype="<i8", count=1 + 2 * n)[1:]
    start = 8 * (1 + 2 * n)
    end = start + int(head[n:].sum())
    return Block(head[:n], head[n:], raw[start:end], raw[end:])


def _as_stream(parts: list[pa.RecordBatch]) -> bytes:
    """Carried columns as Arrow writes them, so that all kinds of columns come back as they were."""
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(parts).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def blocks_table(docs: DataFrame) -> tuple[DataFrame, int]:
    """(rows (block long, size long, blob) of (doc_id long, text, carried columns), bucketed by block; bytes of text). Rows
    without doc_id are left out. The number of buckets follows the bytes and, for small inputs, the cores."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, ids, data, rest, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            carried = _as_stream(rest) if rest and rest[0].num_columns else b""
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + count], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_block(ids, data, carried)], pa.binary())], names=["block", "size", "blob"])

        for batch in batches:
            others, begin = batch.select(range(2, batch.num_columns)), 0
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                own = (text.as_py() or "").encode("utf-8")
                ids.append(doc_id)
                data.append(own)
                size += len(own)
                if size >= BLOCK_BYTES or len(ids) >= 50_000:
                    rest.append(others.slice(begin, i + 1 - begin))
                    yield flush()
                    count, ids, data, rest, size, begin = count + 1, [], [], [], 0, i + 1
            if begin < batch.num_rows:
                rest.append(others.slice(begin))
        if ids:
            yield flush()

    spark = docs.sparkSession
    first, name = staged_path(spark, "packed"), f"tallyweave_{uuid.uuid4().hex}"
    with small_batches(spark):
        docs.where("doc_id is not null").mapInArrow(tidy(packed), "block long, size long, blob binary").write.parquet(first)
    rows = spark.read.schema("block long, size long, blob binary").parquet(first)
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES), min(-(-total // LEAST_BYTES), 8 * spark.sparkContext.defaultParallelism))
    rows.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", staged_path(spark, name)).format("parquet").saveAsTable(name)
    remove(spark, first)
    atexit.register(_drop, spark, name)
    return spark.table(name), total


def _drop(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone by then
        pass


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, kept for the blocks to come."""
    if len(_known_powers) == 0 or len(_known_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 150_000)
        _known_powers[:] = [np.multiply.accumulate(np.full(size, base, dtype=np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _known_powers[0], _known_powers[1]


_known_powers: list[np.ndarray] = []


class Spans(NamedTuple):
    """Texts to compare: from ``first`` to ``last`` + 50, of the block's ``doc``-th document, with the place and the hash
    of what they have in common."""

    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def text_hashes(block: Block, spans: Spans) -> np.ndarray:
    """A hash of each text and of the anchor's place in it."""
    out = np.empty(len(spans.first), dtype=np.uint64)
    order = np.argsort(spans.first, kind="stable")
    cuts = np.searchsorted(spans.first[order], np.arange(0, len(block.data) + SPAN, SPAN))
    for at, (i, j) in zip(range(0, len(block.data), SPAN), zip(cuts[:-1], cuts[1:], strict=True), strict=False):
        if i == j:
            continue
        rows = order[i:j]
        raw = np.frombuffer(block.data[at : at + SPAN + WIDEST] + b"\0" * 8, dtype=np.uint8)
        n = len(raw) - 8
        power, inverse = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        for k in range(0, n, STRETCH):
            m = min(STRETCH, n - k)
            np.cumsum(_mix(_words(raw[k:], m)) * power[k : k + m], out=sums[k + 1 : k + 1 + m])
            sums[k + 1 : k + 1 + m] += sums[k]
        a, b = spans.first[rows] - at, spans.last[rows] + LENGTH - at
        shape = ((b - a) << 8 | (spans.place[rows] - spans.first[rows])).astype(np.uint64)
        out[rows] = _mix((sums[b - 7] - sums[a]) * inverse[a] + shape * _ODD[0])
    return out


def padded_texts(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The texts as rows of ten 64-bit words, zeros behind their end; ``data`` has ``WIDEST`` bytes more."""
    out = np.lib.stride_tricks.sliding_window_view(data, WIDEST)[first]
    out[np.arange(WIDEST) >= size[:, None]] = 0
    return out.view("<u8")


def differs(data: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each text has other bytes than the one before it; few texts are widened at a time."""
    raw = np.frombuffer(data + b"\0" * WIDEST, dtype=np.uint8)
    out = np.ones(len(first), dtype=bool)
    resized = size[1:] != size[:-1]  # zeros at the end may be the text's own
    for at in range(0, len(first), COMPARED):
        begin = max(at - 1, 0)
        words = padded_texts(raw, first[begin : at + COMPARED], size[begin : at + COMPARED])
        out[begin + 1 : at + COMPARED] = (words[1:] != words[:-1]).any(axis=1) | resized[begin : at + COMPARED - 1]
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(buckets)


def distinct_hashes(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, 5 bytes of hash) of the anchors as numbers, whether two of the block's documents have each, how
    often each occurs, and which of them each anchor has."""
    keys = bucket_of(block.hash, buckets) << np.uint64(40) | block.hash & _LOW
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(new)
    own = np.empty(len(keys), dtype=np.int64)
    own[order] = np.cumsum(new) - 1
    if not len(head):
        return keys, new, own, own
    ids = block.ids[block.doc[order]]
    return keys[head], np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head), np.diff(np.append(head, len(keys))), own


def _split(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of each run of a sorted array."""
    if len(bucket):
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(bucket[a]), a, b


def distinct_texts(block: Block, times: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many different texts each distinct anchor has in the block; anchors of fewer than ``OFTEN`` occurrences keep
    their number of occurrences."""
    rows = np.flatnonzero((times >= OFTEN)[own]) if len(own) else own
    if not len(rows):
        return times
    text = text_hashes(block, Spans(block.place[rows], block.first[rows], block.last[rows], block.doc[rows], block.hash[rows]))
    order = np.lexsort((text, own[rows]))
    a, b = own[rows][order], text[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    out = times.copy()
    out[np.unique(a)] = 0
    np.add.at(out, a[new], 1)
    return out


def ask_anchors(buckets: int) -> Callable:
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = unpack_block(blob.as_py())
                keys, twice, times, own = distinct_hashes(block, buckets)
                times = distinct_texts(block, times, own)
                five = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
                parts = list(_split((keys >> np.uint64(40)).astype(np.int64)))
                often = [np.flatnonzero(times[a:b] >= OFTEN) for _, a, b in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([p for p, _, _ in parts], pa.int32()), pa.array([block_id] * len(parts), pa.int64()),
                    pa.array([five[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in parts], pa.binary()),
                    pa.array([np.stack([o, times[a:b][o]]).astype("<u4").tobytes() for o, (_, a, b) in zip(often, parts, strict=True)], pa.binary()),
                ], names=["bucket", "block", "keys", "twice", "often"])

    return asked


def answer_anchors(hot: int) -> Callable:
    """Two bits for each key of each block: another document has it too; it has ``hot`` texts or more."""

    def answered(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(k) // 5 for k in rows["keys"]]
        five = np.zeros((sum(sizes), 8), dtype=np.uint8)
        five[:, :5] = np.frombuffer(b"".join(rows["keys"]), dtype=np.uint8).reshape(-1, 5)
        keys = five.view("<u8").ravel()
        twice = np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=n).astype(bool) for t, n in zip(rows["twice"], sizes, strict=True)])
        times, at = np.ones(len(keys), dtype=np.int64), 0
        for often, n in zip(rows["often"], sizes, strict=True):
            place, number = np.frombuffer(often, dtype="<u4").reshape(2, -1)
            times[at + place.astype(np.int64)] = number
            at += n
        order = np.argsort(keys, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        number = np.diff(np.append(head, len(keys)))
        shared, many = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
        shared[order] = np.repeat((number > 1) | np.logical_or.reduceat(twice[order], head), number)
        many[order] = np.repeat(np.add.reduceat(times[order], head) >= hot, number)
        cuts = np.cumsum(sizes)[:-1]
        answers = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(shared, cuts), np.split(many, cuts), strict=True)]
        return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"], "answer": answers})

    return answered


def shared_spans(block: Block, answers: pd.DataFrame, buckets: int) -> Spans:
    """The texts around the block's anchors that other documents have too, given the answers to ``ask_anchors``; of hot
    anchors the 50-byte strings, which take their own hash for the anchor's."""
    keys, _, _, own = distinct_hashes(block, buckets)
    shared, hot = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    known = dict(zip(answers["bucket"], answers["answer"], strict=True))
    for part, a, b in _split((keys >> np.uint64(40)).astype(np.int64)):
        half = len(known[part]) // 2
        for found, bits in ((shared, known[part][:half]), (hot, known[part][half:])):
            found[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
    rows = np.flatnonzero((shared & ~hot)[own])
    spans = Spans(block.place[rows], block.first[rows], block.last[rows], block.doc[rows], block.hash[rows])
    rows = np.flatnonzero((shared & hot)[own])
    if not len(rows):
        return spans
    number = block.last[rows] - block.first[rows] + 1
    first, doc = ragged(block.first[rows], number), np.repeat(block.doc[rows], number)
    each = Spans(first, first, first, doc, np.zeros(len(first), dtype=np.uint64))
    each = each._replace(hash=_mix(text_hashes(block, each) ^ _ODD[1]))
    return Spans(*(np.concatenate(pair) for pair in zip(spans, each, strict=True)))


def regions(block: Block, spans: Spans, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct texts around shared anchors, sorted by bucket: (number of the text for each span, and for each text
    a span that has it with the smallest doc_id, its bucket and its hash). A text spans all 50-byte strings of its
    anchor; spans whose hashes are equal have one text if their bytes are equal."""
    if not len(spans.first):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    h, text = spans.hash, text_hashes(block, spans)
    bucket = bucket_of(h, buckets)
    order = np.lexsort((block.ids[spans.doc], text, h, bucket))
    a, b = h[order], text[order]
    new = differs(block.data, spans.first[order], spans.last[order] + LENGTH - spans.first[order])
    new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    own = np.empty(len(order), dtype=np.int64)
    own[order] = np.cumsum(new) - 1
    heads = order[new]
    return own, heads, bucket[heads].astype(np.int64), text[heads]


def ask_regions(buckets: int) -> Callable:
    def asked(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = ([], [], [])
        for block_id, blob in zip(blocks["block"], blocks["blob"], strict=True):
            block = unpack_block(blob)
            spans = shared_spans(block, answers, buckets)
            _, rows, bucket, text = regions(block, spans, buckets)
            for part, a, b in _split(bucket):
                out[0].append(part)
                out[1].append(block_id)
                out[2].append(_pack_regions(block, Spans(*(x[rows[a:b]] for x in spans)), text[a:b]))
        return pd.DataFrame({"bucket": np.array(out[0], dtype=np.int32), "block": np.array(out[1], dtype=np.int64), "texts": out[2]})

    return asked


def _pack_regions(block: Block, spans: Spans, text: np.ndarray) -> bytes:
    import zstandard

    size = spans.last + LENGTH - spans.first
    data = np.frombuffer(block.data, dtype=np.uint8)[ragged(spans.first, size)]
    head = np.concatenate([np.array([len(size)], dtype=np.uint64), spans.hash, text, block.ids[spans.doc].astype(np.uint64)])
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + size.astype(np.uint8).tobytes() + data.tobytes())


def _unpack_regions(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype="<u8", count=1)[0])
    h, text, least = np.frombuffer(raw, dtype="<u8", count=3 * n, offset=8).reshape(3, n)
    return h, text, least.astype(np.int64), np.frombuffer(raw, dtype=np.uint8, count=n, offset=8 + 24 * n).astype(np.int64), raw[8 + 25 * n :]


def answer_regions(rows: pd.DataFrame) -> pd.DataFrame:
    """For each text of each block: the smallest doc_id that has the text, and bits of the 50-byte strings in it that a
    still smaller doc_id has in another text around the same anchor."""
    give_back()  # what the group before held
    parts = [_unpack_regions(t) for t in rows["texts"]]
    h, text, least, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
    data, cuts = b"".join(p[4] for p in parts), np.cumsum([len(p[0]) for p in parts])[:-1]
    parts.clear()
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    order = np.lexsort((text, h))
    a, b = h[order], text[order]
    new = differs(data, starts[order], size[order])
    new[1:] |= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    own = np.empty(len(order), dtype=np.int64)
    own[order] = np.cumsum(new) - 1
    first = order[new]
    lowest = np.minimum.reduceat(least[order], np.flatnonzero(new))
    group = h[first]  # sorted by anchor
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    number = np.diff(np.append(head, len(first)))
    several = number > 1  # a text alone is one range of equal strings: there is nothing to order it with
    members = ragged(head[several], number[several])
    bits = np.zeros(len(first), dtype=np.uint32)
    if len(members):
        bits[members] = earlier_strings([data[starts[m] : starts[m] + size[m]] for m in first[members]], lowest[members], number[several])
    answer = np.empty(len(h), dtype=[("doc", "<i8"), ("bits", "<u4")])
    answer["doc"], answer["bits"] = lowest[own], bits[own]
    return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"], "answer": [a.tobytes() for a in np.split(answer, cuts)]})


def earlier_strings(texts: list[bytes], ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Bits of the 50-byte strings (bit n: from place n on) of each text that a text of its group with a smaller id has.

    Groups are runs of ``number`` texts. The texts of a group are joined by separators and suffix-sorted; suffixes that
    start with the same 50 bytes are neighbours then.
    """
    bits = np.zeros(len(texts), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.add.reduceat(sizes + 1, np.concatenate([[0], np.cumsum(number)[:-1]])) + 1
    ends = np.cumsum(number)
    by_size = np.argsort(chars, kind="stable")
    at = 0
    while at < len(by_size):
        till, total = at, 0
        while till < len(by_size) and (till == at or total + chars[by_size[till]] <= 100_000):
            total += chars[by_size[till]]
            till += 1
        own = by_size[at:till]
        at = till
        members = ragged(ends[own] - number[own], number[own])
        raw = np.frombuffer(b"".join([texts[m] for m in members]) + b"\0" * 8, dtype=np.uint8)
        size = sizes[members]
        last = np.zeros(len(members), dtype=np.int64)  # a text's extra symbols: a separator, and an end after the last
        last[np.cumsum(number[own]) - 1] = 1
        begin = np.concatenate([[0], np.cumsum(size + 1 + last)])
        text = np.ones(begin[-1], dtype=np.int64)
        plain = np.concatenate([[0], np.cumsum(size)])
        place = ragged(begin[:-1], size)
        text[place] = raw[: plain[-1]].astype(np.int64) + 2
        text[begin[1:][last > 0] - 1] = 0
        cuts = np.concatenate([[0], begin[1:][last > 0]])
        if len(own) >= 12 or chars[own[-1]] <= LONG_TEXT:
            sa = sort_many(text, cuts)
        else:
            sa = np.concatenate([np.array(sort_suffixes(text[a:b].tolist()), dtype=np.int64) + a for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        source = np.full(len(text), -1, dtype=np.int64)
        good = size >= LENGTH
        starts = ragged(begin[:-1][good], size[good] - LENGTH + 1)
        source[starts] = np.repeat(np.flatnonzero(good), size[good] - LENGTH + 1)
        sa = sa[source[sa] >= 0]
        member = source[sa]
        offset = sa - begin[member]
        where = plain[member] + offset
        words = _words(raw, plain[-1])
        same = np.ones(len(sa), dtype=bool)
        for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
            w = words[where + k]
            same[1:] &= w[1:] == w[:-1]
        group = np.repeat(np.arange(len(own)), number[own])[member]
        same[1:] &= group[1:] == group[:-1]
        same[0] = False
        head = np.flatnonzero(~same)
        low = np.minimum.reduceat(ids[members[member]], head)
        hit = ids[members[member]] > np.repeat(low, np.diff(np.append(head, len(sa))))
        np.bitwise_or.at(bits, members[member[hit]], np.uint32(1) << offset[hit].astype(np.uint32))
    return bits


def covered_bytes(block: Block, answers: pd.DataFrame, found: pd.DataFrame, buckets: int) -> np.ndarray:
    """Whether each byte of the block lies in a 50-byte string that a smaller doc_id also has."""
    spans = shared_spans(block, answers, buckets)
    own, _, bucket, _ = regions(block, spans, buckets)
    known = dict(zip(found["bucket"], found["answer"], strict=True))
    parts = [np.frombuffer(known[part], dtype=[("doc", "<i8"), ("bits", "<u4")]) for part, _, _ in _split(bucket)]
    change = np.zeros(len(block.data) + 1, dtype=np.int32)
    if len(own):
        answer = np.concatenate(parts)[own]
        ids = block.ids[spans.doc]
        whole = ids > answer["doc"]
        np.add.at(change, spans.first[whole], 1)
        np.add.at(change, spans.last[whole] + LENGTH, -1)
        some = np.flatnonzero((ids == answer["doc"]) & (answer["bits"] > 0))
        for bit in range(LENGTH - GRAM + 1):
            hit = spans.first[some[answer["bits"][some] >> np.uint32(bit) & 1 > 0]] + bit
            np.add.at(change, hit, 1)
            np.add.at(change, hit + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def mark_blocks(buckets: int, texts: bool) -> Callable:
    def marked(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        answers, out = answers.to_pandas(), []
        asked, found = answers[answers["kind"] == 1], answers[answers["kind"] == 2]
        for blob in blocks["blob"]:
            block = unpack_block(blob.as_py())
            gone = covered_bytes(block, asked, found, buckets)
            raw, rows, left = np.frombuffer(block.data, dtype=np.uint8), [], []
            for doc_id, at, n in zip(block.ids.tolist(), block.starts.tolist(), block.sizes.tolist(), strict=True):
                own = gone[at : at + n]
                removed = int(np.count_nonzero(own))
                kept = raw[at : at + n][~own].tobytes() if removed else block.data[at : at + n]
                spans = int(own[:1].sum() + np.count_nonzero(own[1:] > own[:-1])) if removed else 0
                rows.append((doc_id, n, removed, spans, hashlib.sha256(kept).hexdigest()))
                if texts:
                    left.append(kept.decode("utf-8", "ignore"))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)]
            names = [f.split()[0] for f in OUT.split(", ")]
            if texts:
                columns.append(pa.array(left, pa.string()))
                names.append("kept")
                if block.carried:
                    carried = pa.ipc.open_stream(block.carried).read_all()
                    columns.extend(carried.columns)
                    names.extend(carried.column_names)
            out.append(pa.Table.from_arrays(columns, names=names))
        return pa.concat_tables(out)

    return marked


def remove_repeats(docs: DataFrame, texts: bool = True, buckets: int | None = None, hot: int = HOT_ANCHOR) -> DataFrame:
    """Remove each byte that a 50-byte string covers which also starts in a document with a smaller doc_id.

    ``docs`` has doc_id (a whole number) and text. Strings lie within one document and are judged on the input. Null
    texts count as empty. Rows with one doc_id, repeated rows too, do not remove from each other. A null doc_id is no
    smaller one and loses nothing. Returns a row for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 (of the remaining bytes) and, if ``texts``, kept (their text without what is left of cut characters) and
    each further column of ``docs`` as it is, named _c0, _c1, ... in order. ``buckets`` of anchors and the texts from
    which an anchor is ``hot`` change no result.
    """
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")] if texts else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)])
    carried = docs.drop("doc_id", "text").schema.fields
    blocks, total = blocks_table(docs)
    buckets = buckets or max(8, -(-total * 3 // 40 // BUCKET_KEYS))
    asked = blocks.select("block", "blob").mapInArrow(tidy(ask_anchors(buckets)), "bucket int, block long, keys binary, twice binary, often binary")
    answers = stage(asked.groupBy("bucket").applyInPandas(answer_anchors(hot), "bucket int, block long, answer binary"), "anchors")
    around = blocks.select("block", "blob").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(ask_regions(buckets), "bucket int, block long, texts binary")
    found = stage(around.groupBy("bucket").applyInPandas(answer_regions, "bucket int, block long, answer binary"), "strings")
    both = answers.withColumn("kind", F.lit(1)).union(found.withColumn("kind", F.lit(2)))
    kinds = StructType([*StructType.fromDDL(OUT + (", kept string" if texts else "")).fields, *carried])
    out = blocks.select("block", "blob").groupBy("block").cogroup(both.groupBy("block")).applyInArrow(mark_blocks(buckets, texts), kinds)
    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    nameless = docs.where("doc_id is null").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"),
        *([text.alias("kept"), *[f.name for f in carried]] if texts else []),
    )
    return out.unionByName(nameless)


def repeats_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text"), texts=False)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, with their own columns, n_chars as of the text left. What is left of
    cut characters goes too, and so does a document of which no text is left. Null texts stay null; an empty table gives
    none."""
    names = {c: c.lower() for c in docs.columns}
    others = [c for c in docs.columns if names[c] not in ("doc_id", "text")]
    missing = f"_missing_{len(others)}"
    out = remove_repeats(docs.withColumn(missing, F.col("text").isNull())).where("n_removed = 0 or kept != ''")
    kind = {f.name: f.dataType for f in docs.schema.fields}
    columns = {c: F.col(f"_c{i}") for i, c in enumerate(others)}
    for c in docs.columns:
        if names[c] == "doc_id":
            columns[c] = F.col("doc_id").cast(kind[c])
        elif names[c] == "text":
            columns[c] = F.when(~F.col(f"_c{len(others)}"), F.col("kept"))
        elif names[c] == "n_chars":
            columns[c] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind[c])).otherwise(columns[c])
    return out.select(*[columns[c].alias(c) for c in docs.columns])
