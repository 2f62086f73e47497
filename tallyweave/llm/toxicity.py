"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exceptions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import first_by_hash, stage

# Characters that stand for a Latin letter, as homoglyphs or by digit substitution.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ⅰ": "i", "ı": "i", "ł": "l", "ø": "o",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
# Lexicon where no labels are known, and phrases in which a word of any lexicon does not count.
SEED_LEXICON = ("bastard", "clown", "cretin", "disgusting", "dumb", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
EXCEPTIONS = ("class clown", "clown fish", "idiot light", "idiot proof", "loser bracket", "sore loser", "trash bag", "trash bin", "trash can", "trash collection", "keep it simple stupid", "oxy moron")
FIT_TOXIC, FIT_CLEAN = 6000, 12000  # labelled documents that the lexicon is fitted on at most, the first by hash of doc_id
MAX_TERMS = 4000
MIN_G2, MIN_LIFT = 14.0, 40.0

_FOLD = str.maketrans(HOMOGLYPHS | SUBSTITUTIONS)
_WORD = re.compile(r"[^\W\d_]+")
_automata: dict = {}


def fold(text: str) -> str:
    """Lower case, homoglyphs to Latin letters, digits and signs to the letters they stand for."""
    return text.lower().translate(_FOLD)


def automaton(weights: dict[str, float], exceptions: tuple[str, ...]):
    """An Aho-Corasick automaton of terms (weight) and exception phrases (None)."""
    import ahocorasick

    key = (tuple(sorted(weights.items())), exceptions)
    if key not in _automata:
        found = ahocorasick.Automaton()
        for term, weight in weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        _automata.clear()
        _automata[key] = found
    return _automata[key]


def matched_weight(text: str, found) -> tuple[float, int]:
    """Sum and number of the whole-word terms in a folded text that lie in no exception phrase."""
    hits, spared = [], []
    size = len(text)
    for end, (length, weight) in found.iter(text):
        start = end - length + 1
        if (start and text[start - 1].isalpha()) or (end + 1 < size and text[end + 1].isalpha()):
            continue
        (hits if weight is not None else spared).append((start, end, weight))
    if spared and hits:
        starts = np.asarray([s for s, _, _ in spared])
        reach = np.maximum.accumulate([e for _, e, _ in sorted(spared)])
        order = np.sort(starts)
        at = np.searchsorted(order, [s for s, _, _ in hits], "right") - 1
        hits = [h for h, i in zip(hits, at, strict=True) if i < 0 or reach[i] < h[1]]
    return sum(w for _, _, w in hits), len(hits)


def measure(text: str, found) -> float:
    """Matched weight divided by a slowly growing length, so that long texts need more of it."""
    folded = fold(text)
    weight, n = matched_weight(folded, found) if len(found) else (0.0, 0)
    return weight / (1 + len(text) / 6) ** 0.25 if n else 0.0


def fit_toxicity(docs: DataFrame, labels: DataFrame, train, max_toxic: int = FIT_TOXIC, max_clean: int = FIT_CLEAN) -> dict:
    """A lexicon with weights and a threshold from the labelled rows where ``train`` holds.

    Only the first ``max_toxic`` toxic and ``max_clean`` other documents by hash of doc_id are used. A folded word
    enters if its documents are toxic significantly often; its weight is its smoothed log odds. With no toxic label
    the seed lexicon stands in.
    """
    known = labels.select("doc_id", "toxic").where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = first_by_hash(known, "toxic", "doc_id", max(max_toxic, max_clean))
    known = known.withColumn("_n", F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")))
    known = known.where(F.col("_n") <= F.when(F.col("toxic") == 1, max_toxic).otherwise(max_clean))
    known = known.select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).alias("toxic"))
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("toxic", "text")
    sample = stage(sample, "sample")  # max_toxic + max_clean documents

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {True: Counter(), False: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[toxic].update({"", *_WORD.findall(fold(text.as_py()))})
        names = list(seen[True])  # words of clean documents alone can't enter
        yield pa.RecordBatch.from_arrays(
            [pa.array([*names, *seen[False]], pa.string()), pa.array([seen[True][w] for w in names] + [0] * len(seen[False]), pa.int64()),
             pa.array([0] * len(names) + list(seen[False].values()), pa.int64())], names=["word", "t", "c"],
        )

    table = sample.mapInArrow(words, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    table = table.where("t >= 3 or word = ''")
    total = table.where("word = ''").first()
    nt, nc = (total.t, total.c) if total else (0, 0)
    weights = {}
    if nt:
        odds = F.log((F.col("t") + 0.5) / (nt + 1.0)) - F.log((F.col("c") + 0.5) / (nc + 1.0))
        n = F.col("t") + F.col("c")
        g2 = 2 * (F.col("t") * F.log(F.col("t") * (nt + nc) / (n * nt)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") * (nt + nc) / (n * max(nc, 1)))).otherwise(0.0))
        found = table.where("word != ''").select("word", odds.alias("w"), g2.alias("g2")).where((F.col("g2") >= MIN_G2) & (F.col("w") >= math.log(MIN_LIFT)))
        weights = {r.word: float(r.w) for r in found.orderBy(F.col("g2").desc(), "word").limit(MAX_TERMS).collect()}
    if not weights:
        weights = dict.fromkeys(SEED_LEXICON, 4.0)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(weights, EXCEPTIONS)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([measure(t.as_py(), found) for t in batch.column(1)], pa.float64())], names=["toxic", "x"])

    rows = sample.mapInArrow(measured, "toxic boolean, x double").collect() if nt else []
    return {"weights": weights} | threshold(np.asarray([r.x for r in rows]), np.asarray([r.toxic for r in rows], dtype=bool))


def threshold(x: np.ndarray, toxic: np.ndarray) -> dict:
    """The cut with the fewest errors on the fitted rows (in the middle of the widest such gap) and a slope for scores."""
    if not len(x) or not toxic.any():
        return {"cut": 1.0, "slope": 3.0}
    values = np.unique(np.append(x, 0.0))
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1)
    clean, bad = np.sort(x[~toxic]), np.sort(x[toxic])
    errors = (len(clean) - np.searchsorted(clean, cuts)) + np.searchsorted(bad, cuts)
    best = np.flatnonzero(errors == errors.min())
    width = np.append(np.diff(values), 0.0)[best]
    cut = float(cuts[best[np.argmax(width)]])
    return {"cut": cut, "slope": 4.0 / max(cut, 1e-6)}


def score_toxicity(docs: DataFrame, model: dict, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id and score (0..1) for each row of (doc_id, text); other columns are ignored.

    Null and empty texts, and texts without a term, get the score of weight 0, under a half. Repeated rows score
    alike; whole texts count, of any length.
    """
    weights, cut, slope = model["weights"], model["cut"], model["slope"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(weights, exceptions)
        for batch in batches:
            x = np.asarray([measure(t.as_py() or "", found) for t in batch.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(slope * (x - cut), -50, 50))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    out = score_toxicity(docs, fit_toxicity(docs, labels, part != 0))
    return out.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
