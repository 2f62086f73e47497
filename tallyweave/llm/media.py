"""Telephony audio columns: G.711 and IMA ADPCM in WAV containers, expanded and resampled to PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17  # format tags
RATE = 8000
UNIT = 64
SLICE = 2_000_000  # bytes of payload that are decoded at once

# Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(power == 0, low + 8, low + 264 << np.maximum(power - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) of mono IMA ADPCM to (blocks, samples): one step decodes a nibble of every block at once."""
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.uint8)
    codes[0::2] = (blocks[:, 4:] & 15).T
    codes[1::2] = (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = value
    for row, code in enumerate(codes, 1):
        step = STEPS[index]
        change = step >> 3
        change += np.where(code & 4, step, 0)
        change += np.where(code & 2, step >> 1, 0)
        change += np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGES[code & 7], 0, 88)
        out[row] = value
    return out.T


def decode(tag: int, data: bytes, block: int = 1) -> np.ndarray:
    """Samples of mono audio as 16-bit PCM. An incomplete ADPCM block or PCM sample at the end is left out."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if tag == MULAW:
        return MULAW_PCM[raw]
    if tag == ALAW:
        return ALAW_PCM[raw]
    if tag == ADPCM:
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    if tag == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"no decoder for format {tag}")


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation between samples, in whole numbers."""
    if rate == to or not len(x):
        return x.astype(np.int16)
    at = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    y = x.astype(np.int64)
    return (y[i] + (y[np.minimum(i + 1, len(x) - 1)] - y[i]) * part // to).astype(np.int16)


def wav(tag: int, data: bytes, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file. Chunks are padded to even length, as the format asks."""
    bits = {PCM: 16, ADPCM: 4}.get(tag, 8)
    block = 2 if tag == PCM else block
    per_block = (block - 4) * 2 + 1 if tag == ADPCM else 1
    extra = b"" if tag == PCM else struct.pack("<HH", 2, per_block) if tag == ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * block // per_block, block, bits) + extra
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, len(data) // block * per_block)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and form:
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the WAV file")


def expand_audio(media: DataFrame, rate: int = 16000) -> DataFrame:
    """Stored telephony audio as PCM: (id, media binary) to (id, codec int, pcm binary), a 16-bit WAV at ``rate``.

    Mu-law, A-law, IMA ADPCM and PCM WAV files are read. Null media, and media that is no such file, give null codec
    and pcm. Files are expanded one by one, so memory follows the longest.
    """

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codecs, out = [], []
            for item in batch.column(1):
                try:
                    tag, own, block, data = read_wav(item.as_py() or b"")
                    out.append(wav(PCM, resample(decode(tag, data, block), own, rate).astype("<i2").tobytes(), rate))
                    codecs.append(tag)
                except (ValueError, struct.error):
                    codecs.append(None)
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codecs, pa.int32()), pa.array(out, pa.binary())], names=["id", "codec", "pcm"])

    return media.select("id", "media").mapInArrow(expanded, "id long, codec int, pcm binary")


def store_texts(docs: DataFrame) -> DataFrame:
    """Texts as audio: (doc_id, text) to (id, n_bytes, media), UTF-8 bytes (n_bytes of them) padded with zeros to a positive
    multiple of 64 and kept as the 8-bit samples of a mu-law WAV file. Null texts count as empty; equal texts give equal
    files; a null id stays null; an empty table gives none."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, texts = batch.column(0).slice(at, 1000), [t.as_py() or "" for t in batch.column(1).slice(at, 1000)]
                sizes = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, sizes, pa.array([wav(MULAW, padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stored, "id long, n_bytes long, media binary")


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def features(payloads: list[bytes]) -> list[str]:
    """Levels of each payload (a multiple of 64 bytes) under the three codecs, zero crossings, and the checksum of its
    mu-law samples as 16-bit PCM resampled from 8 to 16 kHz. ADPCM takes it as blocks of 64 bytes."""
    sizes = np.array([len(p) for p in payloads])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    level = lambda squares, at, n: np.sqrt(np.add.reduceat(squares, at) / n).astype(np.int64)
    mu, a = MULAW_PCM[raw].astype(np.int64), ALAW_PCM[raw].astype(np.int64)
    blocks = decode_adpcm(raw.reshape(-1, UNIT))
    per_block = (blocks.astype(np.int64) ** 2).sum(axis=1)
    ends = starts + sizes - 1
    follows = np.concatenate([mu[1:], mu[-1:]])
    follows[ends] = mu[ends]
    crossings = np.add.reduceat((mu < 0) != (follows < 0), starts, dtype=np.int64)
    pcm = [zlib.crc32(resample(decode(MULAW, p), RATE, 2 * RATE).astype("<i2").tobytes()) for p in payloads]
    levels = level(mu * mu, starts, sizes), level(a * a, starts, sizes), level(per_block, starts // UNIT, sizes // UNIT * blocks.shape[1])
    return [
        f"mu={m};a={b};adpcm={c};crossings={z};pcm16k={x:08x}"
        for m, b, c, z, x in zip(*levels, crossings, pcm, strict=True)
    ]


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as audio in the shared folder (``store_texts``), read the stored files back and describe them: what
    their payload is, and ``features``. A row for each row; null texts count as empty."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = media.as_py()
                payload = read_wav(media)[3]
                rows.append(((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()), payload))
                size += len(payload)
                if size >= SLICE:
                    yield rows
                    rows, size = [], 0
        if rows:
            yield rows

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            columns = [*zip(*(r for r, _ in rows), strict=True), features([p for _, p in rows])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    with small_batches(docs.sparkSession):
        stored = stage(store_texts(docs), "media")
    return stored.mapInArrow(
        digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
