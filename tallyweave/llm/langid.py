"""Language identification: nearest of several centroids per language over TF-IDF vectors of byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import first_by_hash, small_batches, stage, tidy

DIMS = 4096
FIT_ROWS = 400  # labelled documents for each language that centroids are fitted on, the first by hash of doc_id
CENTROIDS = 4
REJECT = 0.6  # of the similarity that all but LOW of the fitted texts of the same length have to a centroid of their language
LOW = 0.01
SIZES = tuple(2**i for i in range(3, 14))  # bytes at which that similarity is taken, from the beginnings of the fitted texts
FEW = 0.05  # of a language's fitted texts; a smaller cluster is no centroid
_SPACE = bytes(32 if i < 128 and not chr(i).isalpha() else i for i in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed counts of 2- and 3-byte grams of the lower-cased text; ASCII other than letters counts as space."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "ignore").translate(_SPACE) + b" ", dtype=np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    out = np.bincount((two * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    three = (two[:-1] << np.uint32(8)) | b[2:]
    return out + np.bincount((three * np.uint32(2246822519)) >> np.uint32(20), minlength=DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        row[:] = counts(text)
    np.log1p(out, out=out)
    out *= idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from rows drawn with a fixed seed; the same rows give the same centroids. Clusters of few rows
    are left out, so that no outlier is a centroid."""
    c = x[np.sort(np.random.default_rng(0).choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c[np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c)) >= FEW * len(x)]


def bytes_of(text: str) -> int:
    return len(text.encode("utf-8", "ignore"))


def usual(texts: list[str], centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The cosine to the nearest centroid that all but ``LOW`` of the texts exceed when cut to each of ``SIZES``, never
    falling with the size; a size that no text has takes that of the size before."""
    out = np.zeros(len(SIZES))
    for i, size in enumerate(SIZES):
        cut = [t.encode("utf-8", "ignore")[:size].decode("utf-8", "ignore") for t in texts if bytes_of(t) >= size]
        found = float(np.quantile((vectors(cut, idf) @ centroids.T).max(axis=1), LOW)) if cut else 0.0
        out[i] = max(found, out[i - 1] if i else 0.0)
    return out


def fit_languages(docs: DataFrame, train: F.Column, fit_rows: int = FIT_ROWS, k: int = CENTROIDS) -> dict:
    """A classifier from the rows where ``train`` holds and text and lang are known: document frequencies of all, centroids
    of at most ``fit_rows`` for each language, chosen by hash of doc_id. Returns idf, langs, centroids and each centroid's usual cosines by text size (``usual``)."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = first_by_hash(known.select("doc_id", "lang"), "lang", "doc_id", fit_rows).select(F.col("doc_id").alias("_id")).distinct()
    sample = known.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("lang", "text")
    with small_batches(docs.sparkSession):
        sample = stage(sample, "sample")  # fit_rows documents for a language

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(1):
                total += counts(text.as_py()) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["dim", "n"])

    with small_batches(docs.sparkSession):
        found = known.select("lang", "text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1)
    for dim, n in found:
        df[dim] = n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    def mean(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "mean": [vectors(sorted(rows["text"]), idf).mean(axis=0).astype("<f4").tobytes()]})

    means = {r.lang: np.frombuffer(r["mean"], dtype="<f4") for r in sample.groupBy("lang").applyInPandas(mean, "lang string, mean binary").collect()}

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(rows["text"])
        x = vectors(texts, idf)
        others = [m / np.linalg.norm(m) for lang, m in means.items() if lang != key[0]]
        own = x @ (means[key[0]] / max(np.linalg.norm(means[key[0]]), 1e-12))
        sure = own > (x @ np.stack(others).T).max(axis=1) if others else own >= 0  # wrongly labelled rows make no centroid
        if sure.any():
            x, texts = x[sure], [t for t, ok in zip(texts, sure, strict=True) if ok]
        c = clusters(x, k)
        low = usual(texts, c, idf).astype("<f8").tobytes()
        return pd.DataFrame({"lang": key[0], "low": low, "centroid": [v.astype("<f4").tobytes() for v in c]})

    fitted = sample.groupBy("lang").applyInPandas(fit, "lang string, low binary, centroid binary").orderBy("lang", "centroid").collect()
    return {
        "idf": idf, "langs": [r.lang for r in fitted], "low": np.stack([np.frombuffer(r.low, dtype="<f8") for r in fitted]) if fitted else np.zeros((0, len(SIZES))),
        "centroids": np.stack([np.frombuffer(r.centroid, dtype="<f4") for r in fitted]) if fitted else np.zeros((0, DIMS), np.float32),
    }


def identify_languages(docs: DataFrame, model: dict, reject: float = REJECT, added: tuple = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds three columns, named in ``added``: lang_pred, score (cosine to the nearest centroid, 0..1) and rejected to documents (doc_id, text, ...).

    A text that is null or has no letter is ``und`` with score 0 and rejected, as is every text if the model knows no
    language. Any other text gets the language of its nearest centroid; it is rejected if its cosine is less than
    ``reject`` times the usual one of that language's fitted texts at its size (see ``usual``; between two sizes by the
    logarithm). Whole texts count, of any length.
    Columns named like the added ones are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in added]
    text_at = [c.lower() for c in names].index("text")
    idf, langs, low, centroids = model["idf"], np.asarray([*model["langs"], "und"], dtype=object), model["low"], model["centroids"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t.as_py() or "" for t in batch.column(text_at)]
                score, own, bar = np.zeros(len(texts)), np.full(len(texts), len(langs) - 1), np.full(len(texts), 2.0)
                rows = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if len(centroids) else []
                if rows:
                    cos = vectors([texts[i] for i in rows], idf) @ centroids.T
                    own[rows] = np.argmax(cos, axis=1)
                    score[rows] = np.clip(cos.max(axis=1), 0, 1)
                    bar[rows] = [reject * np.interp(np.log2(max(1, bytes_of(texts[i]))), np.log2(SIZES), low[own[i]]) for i in rows]
                out = score < bar
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(names))), pa.array(langs[own], pa.string()), pa.array(score), pa.array(out)], names=[*names, *added]
                )

    kinds = StructType.fromDDL(f"{added[0]} string, {added[1]} double, {added[2]} boolean")
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    return rows.mapInArrow(tidy(predict), StructType([*rows.schema.fields, *kinds.fields]))


def held_out(docs: DataFrame) -> F.Column:
    """Documents kept from training: crc32 of doc_id as text, mod 3, is 1; a null doc_id is neither."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = fit_languages(docs, train)
    out = identify_languages(docs.select("doc_id", "text"), model)
    with small_batches(docs.sparkSession):
        return stage(out.select("doc_id", held_out(out).alias("held_out"), "lang_pred", "score", "rejected"), "languages")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised, with their own columns."""
    model = fit_languages(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    found = identify_languages(docs, model, added=("_tw_lang", "_tw_score", "_tw_rejected")).where("not _tw_rejected")
    with small_batches(docs.sparkSession):
        return stage(found.select(*[F.col(f"`{c}`") for c in docs.columns]), "identified")
