"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import bisect
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, spared, stage
from .suffix_array import ragged

CAPACITY = 2048
SALT_ROWS, SALTS = 500, 1024  # pieces of one length that a task ranks, and most parts that a length is cut in
CACHE_WORDS = 700_000  # about 180 MB of a Python worker
TEXT_BYTES = 4_000_000  # of texts that are encoded at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("token ids are kept as little-endian 32-bit numbers")

_tokenizers: dict = {}  # a Python worker loads a tokenizer once, whatever tasks it runs


class WordCache(dict):
    """Little-endian ids of text parts between spaces, which the tokenizer's pre-tokenizer never joins.

    It also takes a run of letters and a full stop or comma after it apart, and lower-cases all; so a word is encoded
    once for all its forms.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; every distinct part of them is looked up once."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.known(words)
        table = np.frombuffer(b"".join(known), dtype="<u4")
        size = np.array([len(k) for k in known], dtype=np.int64) // 4
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        end = np.concatenate([[0], np.cumsum(size[which])])
        ids = table[ragged(first[which], size[which])]
        cuts = end[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts. Only plain words and parts of another kind are kept, not the forms of a word."""
        if len(self) > CACHE_WORDS:
            self.clear()
        out: list[bytes] = [b""] * len(parts)
        waiting: dict[str, list[tuple[int, str]]] = {}
        tokenize, ends = self.model.tokenize, {"": b""} | {e: self.whole([e])[0] for e in ".,"}
        for i, part in enumerate(parts):
            found = self.get(part)
            if found is None:
                word, end = (part[:-1], part[-1]) if part[-1:] in (".", ",") else (part, "")
                if word.isalpha() and "\u0130" not in word and "\u03a3" not in word:  # these two have no plain lower case
                    word = word.lower()
                    found = self.get(word)
                    if found is None and word.isascii():
                        found = self[word] = array("I", [t.id for t in tokenize(word)]).tobytes()
                else:
                    word, end = part, ""
                if found is None:
                    waiting.setdefault(word, []).append((i, end))
                    continue
                found += ends[end]
            out[i] = found
        for (word, places), found in zip(waiting.items(), self.whole(list(waiting)), strict=True):
            self[word] = found
            for i, end in places:
                out[i] = found + ends[end]
        return out

    def whole(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]


def word_cache(path: str) -> WordCache:
    if path not in _tokenizers:
        _tokenizers[path] = WordCache(path)
    return _tokenizers[path]


def encoded(texts: pa.Array, cache: WordCache) -> Iterator[bytes]:
    """The ids of each text, null as empty, some megabytes of text at a time."""
    texts = pc.fill_null(texts, "")
    bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        till = max(at + 1, int(np.searchsorted(bytes_before, bytes_before[at] + TEXT_BYTES, "right")) - 1)
        yield from cache.ids(texts.slice(at, till - at))
        at = till


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` tokens; ``tokenizer_path`` is a file that every executor has."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = word_cache(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), cache), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        return stage(rows.mapInArrow(pieces, PIECES), "pieces")


def plan_bins(counts: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Pack ``counts[n]`` pieces of every length n = 1..capacity, given only these counts.

    Lengths above a third of the capacity come first, longest first: two of them at most fit a bin, so each is matched
    with the longest other one that fits beside it. The shorter lengths follow, longest first, each piece into the bin
    with the smallest gap that takes it, or a new one. Bins alike are handled together, so the work depends on the
    number of lengths, not of pieces. Returns intervals (length, first rank, bins, pieces a bin, first bin, offset):
    the pieces of a length, by rank, fill these bins one after the other.
    """
    capacity = len(counts) - 1
    left = [int(c) for c in counts]
    used = [0] * (capacity + 1)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan, bins = [], 0

    def place(length: int, number: int, each: int, first: int, offset: int) -> None:
        plan.append((length, used[length], number, each, first, offset))
        used[length] += number * each
        left[length] -= number * each
        gap = capacity - offset - each * length
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    third = capacity // 3
    for length in range(capacity, third, -1):
        mate = min(length, capacity - length)
        while left[length]:
            while mate > third and not (left[mate] >= 2 if mate == length else left[mate]):
                mate -= 1
            if mate <= third:
                number = left[length]
                place(length, number, 1, bins, 0)
            elif mate == length:
                number = left[length] // 2
                place(length, number, 2, bins, 0)
            else:
                number = min(left[length], left[mate])
                plan.append((length, used[length], number, 1, bins, 0))
                used[length] += number
                left[length] -= number
                place(mate, number, 1, bins, length)
            bins += number
    for length in range(third, 0, -1):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                number = left[length] // each
                if number:
                    place(length, number, each, bins, 0)
                else:
                    number = 1
                    place(length, 1, left[length], bins, 0)
                bins += number
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // length
            full = min(number, left[length] // each)
            rest = number - full
            if full:
                place(length, full, each, first, capacity - gap)
            if rest and left[length]:
                place(length, 1, left[length], first + full, capacity - gap)
                rest -= 1
                full += 1
            if rest:
                if gap not in gaps:
                    gaps[gap] = []
                    bisect.insort(order, gap)
                gaps[gap].append((first + full, rest))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...); other columns stay, but for columns of these two
    names, which are replaced.

    A piece that fills a sequence takes a negative number of its own. Of the others, counts by (length, salt) go to the
    driver, capacity x ``SALTS`` rows at most whatever the input; ``plan_bins`` packs them. Each piece finds its place from
    its rank among pieces of its length, which is the number in earlier salts plus its row number in its own; there are as
    many salts as leave a task about ``salt_rows`` pieces. Lengths must lie in 1..capacity. Repeated rows are pieces of
    their own; an empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset")
    names, pieces = pieces.columns, spared(pieces, {"_salt", "_rank"})
    full = pieces.where(F.col("length") == capacity)
    full = full.select(*[F.col(f"`{c}`") for c in pieces.columns], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    most = rest.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    salts = int(min(SALTS, -(-most // salt_rows) or 1))
    rest = rest.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    table = np.zeros((capacity + 1, salts), dtype=np.int64)
    for length, salt, n in rest.groupBy("length", "_salt").count().collect():
        table[length, salt] = n
    firsts = np.concatenate([[0], np.cumsum(table.ravel())[:-1]]).astype(np.int64)  # of each (length, salt), over all
    plan = sorted(plan_bins(table.sum(axis=1)))
    base = firsts.reshape(table.shape)[:, 0]
    lengths, rank, _, each, first_bin, offset = (np.asarray(c, dtype=np.int64) for c in (zip(*plan, strict=True) if plan else [[]] * 6))
    starts = base[lengths] + rank if len(plan) else rank
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = rest.withColumn("_rank", F.row_number().over(order))

    inner = pieces.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, salt, row = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_salt", "_rank"))
            rank = firsts[n * salts + salt] + row - 1
            at = np.searchsorted(starts, rank, "right") - 1
            behind = rank - starts[at]
            out = [batch.column(i) for i in range(len(inner))] + [pa.array(first_bin[at] + behind // each[at]), pa.array(offset[at] + behind % each[at] * n)]
            yield pa.RecordBatch.from_arrays(out, names=[*inner, "sequence_id", "offset"])

    kinds = StructType([*pieces.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    return full.unionAll(ranked.mapInArrow(placed, kinds)).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack whole documents, each its tokens and an end id 0, into sequences of at most ``capacity`` tokens.

    ``docs`` has doc_id, text; other columns are ignored. Only documents longer than the capacity are cut. Null and
    empty texts are the end id alone; a null doc_id stays null; repeated rows are packed as often as they occur.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset; an empty table gives none.
    """
    return pack(tokenized_pieces(docs, tokenizer_path, capacity), capacity)
