"""Each operator on small and awkward inputs, against brute force, round trips or stated results."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import ann, chat_format, common, langid, licenses, media, mixing, packing, queries, simhash, suffix_array, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, carried int, toxic string"
LONG = " ".join(f"word{i % 97} tail{i % 31}," for i in range(4000))
PASSAGE = "This passage of more than fifty bytes stands in several of the documents, äöü and all."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 0.5, 7, "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [
        (1, "The quick brown fox, MIT License, jumps. " + PASSAGE, "en", "a"), (2, None, "en", None), (3, "", None, "b"), (4, PASSAGE + " Der Rest ist anders.", "de", "a"),
        (5, LONG, "en", "a"), (5, LONG, "en", "a"), (None, PASSAGE, "fr", "c"), (7, "   \n\t ", "en", "a"), (8, "123 !!! 456", None, "c"), (9, "x" * 49, "en", "c"),
        (10, PASSAGE[3:40] + PASSAGE[30:], "en", "b"), (11, "éèê " * 30, "fr", "b"), (12, "éèê " * 30, "fr", "b"),
    ]
    return docs(spark, rows)


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Chat formatting


def test_chat_matches_the_turns(spark):
    rows = [(1, 0, "user", "a \\ [INST] <s> <<s>\\["), (1, 1, "assistant", "</s>[/INST] <<|>> <"), (1, 2, "system<<|>>\n", None), (2, 5, None, "x"), (2, 5, None, "x"),
            (None, 1, "assistant", ""), (3, None, "user", "é🙂 [INST"), (3, 1, "assistant", "🙂")]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "conv_id long, turn long, role string, text string, score double")
    got = {r.conv_id: r for r in chat_format.chat_digest(spark, df).collect()}
    expected = defaultdict(list)
    odd = "</s>[INST] ok [/INST]"
    for c, t, role, text in [*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)]:
        expected[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(expected)
    for c, turns in expected.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_trees_rank_branches_and_leave_cycles_out(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "good", 3.0), (1, 3, 1, "assistant", "bad", -1.0), (1, 4, 2, "user", "more", None),
            (1, 8, 9, "user", "c", 0.0), (1, 9, 8, "user", "c", 0.0), (1, 10, 9, "user", "c", 9.0), (2, 5, 99, "user", "orphan", 0.0), (2, None, None, "user", "none", 0.0)]
    df = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    out = {(r.tree_id, r.rank): r for r in chat_format.format_reply_trees(df).collect()}
    assert {k: r.leaf for k, r in out.items()} == {(1, 1): 4, (1, 2): 3, (2, 1): 5}
    best = out[1, 1]
    assert best.formatted == "[INST] q [/INST]\n<s>good</s>\n[INST] more [/INST]"
    assert [best.formatted[m.start : m.start + m.length] for m in best.loss_mask] == ["good"]
    assert chat_format.format_reply_trees(df, 1).count() == 2 and chat_format.format_reply_trees(df.limit(0)).count() == 0


# Packing


def test_packing_places_all_pieces_without_gaps(spark, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    out = packing.pack_documents(awkward, queries.tokenizer_path()).collect()
    expected = []
    for i, t in texts(awkward):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            expected.append((i, n, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:5]) for r in out)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty(spark), queries.tokenizer_path()).count() == 0
    rows = [(i, 0, [7, 100, 100, 33, 60][i % 5], "x", 1.5, i) for i in range(200)]
    odd = spark.createDataFrame(rows, "doc_id int, piece int, length long, offset string, _salt double, _rank int")
    out = packing.pack(odd, 100, salt_rows=10)
    assert out.columns == ["doc_id", "piece", "length", "_salt", "_rank", "sequence_id", "offset"]
    places = sorted((r.sequence_id, r.offset, r.length) for r in out.collect())
    assert len(places) == 200 and len({p[:2] for p in places}) == 200
    assert all(b == (a[0], a[1] + a[2], b[2]) or b[1] == 0 and b[0] > a[0] for a, b in zip(places, places[1:], strict=False))


def test_bins_of_random_lengths_are_full_and_few():
    rng = np.random.default_rng(3)
    for trial in range(30):
        lengths = rng.integers(1, 1 + int(rng.integers(2, 101)), size=int(rng.integers(1, 800)))
        plan = packing.plan_bins(np.bincount(lengths, minlength=101))
        used, count = defaultdict(list), defaultdict(int)
        for length, rank, number, each, first, offset in plan:
            assert rank == count[length]
            count[length] += number * each
            for b in range(number):
                used[first + b].extend((offset + k * length, length) for k in range(each))
        assert dict(count) == {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        for places in used.values():
            places.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 100
        assert len(used) <= max(math.ceil(lengths.sum() / 100), (lengths > 50).sum()) * 11 // 9 + 1


# Suffix arrays


def test_suffix_arrays_are_sorted():
    rng = random.Random(1)
    for _ in range(200):
        many = [[rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))] + [0] for _ in range(3)]
        starts = np.cumsum([0, *map(len, many)])
        out = suffix_array.sort_many(np.concatenate(many).astype(np.int64), starts)
        for t, a, b in zip(many, starts[:-1], starts[1:], strict=True):
            expected = sorted(range(len(t)), key=lambda i: t[i:])
            assert list(out[a:b] - a) == expected == suffix_array.sort_suffixes(t)


def brute_repeats(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_match_brute_force(spark, awkward):
    rng = random.Random(4)
    passages = ["".join(rng.choice("ab c") for _ in range(rng.randint(40, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages)[rng.randint(0, 9) :] + rng.choice(["", "é", "zz"]) for _ in range(rng.randint(0, 6))), "en", "a") for i in rng.sample(range(500), 120)]
    for df in (awkward, docs(spark, rows)):
        got = sorted((tuple(r) for r in suffix_dedup.repeats_digest(df).collect()), key=repr)
        assert got == brute_repeats(texts(df))
    assert suffix_dedup.repeats_digest(empty(spark)).count() == 0
    for hot in (2, 30):  # anchors whose strings are dealt out one by one
        assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, False, 5, hot).collect()), key=repr) == got
    numbers = df.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert sorted((tuple(r) for r in suffix_dedup.repeats_digest(numbers).collect()), key=repr) == got


def test_long_groups_sort_alone(monkeypatch):
    texts_around = [bytes([65 + i % 7] * (i % 5)) + b"q" * 60 + bytes([97 + i % 11] * 12) for i in range(40)]
    ids, number = np.arange(40), np.array([40])
    together = suffix_dedup.earlier_strings(texts_around, ids, number)
    monkeypatch.setattr(suffix_dedup, "LONG_TEXT", 10)
    assert (together == suffix_dedup.earlier_strings(texts_around, ids, number)).all() and together.any()


def test_texts_of_one_hash_are_told_apart_by_bytes(monkeypatch):
    """With a text hash that is always equal, the bytes and the suffix order alone decide."""
    monkeypatch.setattr(suffix_dedup, "text_hashes", lambda block, spans: np.zeros(len(spans.first), dtype=np.uint64))
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefgh ") for _ in range(400))
    data = [(body[:300] + "x" * i + body[200:]).encode() for i in range(6)] + [body[100:].encode()]
    expected = brute_repeats([(i, d.decode()) for i, d in enumerate(data)])
    block = suffix_dedup.unpack_block(suffix_dedup.pack_block(list(range(7)), data, b""))
    keys, twice, times, _ = suffix_dedup.distinct_hashes(block, 1)
    five = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
    row = pd.DataFrame({"bucket": [0], "block": [0], "keys": [five.tobytes()], "twice": [np.packbits(twice).tobytes()], "often": [b""]})
    asked = suffix_dedup.answer_anchors(1 << 30)(row)
    spans = suffix_dedup.shared_spans(block, asked, 1)
    _, rows, _, text = suffix_dedup.regions(block, spans, 1)
    sent = suffix_dedup._pack_regions(block, suffix_dedup.Spans(*(x[rows] for x in spans)), text)
    found = suffix_dedup.answer_regions(pd.DataFrame({"bucket": [0], "block": [0], "texts": [sent]}))
    gone = suffix_dedup.covered_bytes(block, asked, found, 1)
    assert [int(gone[a : a + n].sum()) for a, n in zip(block.starts, block.sizes, strict=True)] == [r[2] for r in expected]


def test_texts_differ_across_slices(monkeypatch):
    rng = random.Random(6)
    own = [bytes(rng.choice(b"ab") for _ in range(rng.choice((50, 51, 76)))) for _ in range(4)]
    texts_sent = [rng.choice(own) for _ in range(40)] + [own[0], own[0] + b"\0"]
    size = np.array([len(t) for t in texts_sent])
    first = np.cumsum(size) - size
    expected = [True, *(a != b for a, b in zip(texts_sent, texts_sent[1:], strict=False))]
    for compared in (1, 3, 41, 1000):
        monkeypatch.setattr(suffix_dedup, "COMPARED", compared)
        assert suffix_dedup.differs(b"".join(texts_sent), first, size).tolist() == expected
    none = np.zeros(0, dtype=np.int64)
    assert len(suffix_dedup.differs(b"", none, none)) == 0


def test_dropping_repeats_keeps_columns(spark, awkward):
    out = suffix_dedup.drop_repeats(awkward)
    assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
    kept = {r.doc_id: r for r in out.collect()}
    assert 12 not in kept and kept[4].text == " Der Rest ist anders." and kept[4].n_chars == len(kept[4].text) and kept[4].carried == 7
    assert kept[2].text is None and kept[3].text == ""
    odd = awkward.selectExpr("cast(doc_id as int) doc_id", "text", "timestamp'2024-01-02 03:04:05.678901' at", "map('a', 1.5D) m", "cast(null as string) kept", "array(1, null) n_removed", "X'00ff' `_c0`", "1L block")
    out = suffix_dedup.drop_repeats(odd)
    assert out.dtypes == odd.dtypes
    same = {tuple(map(repr, r[2:])) for r in odd.collect()}
    assert {tuple(map(repr, r[2:])) for r in out.collect()} == same and len(same) == 1


# Mixing


def test_mixture_comes_near_its_targets(spark, awkward):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "a", "a", "b", "B", None])) for i in range(900)]
    for df in (docs(spark, rows), awkward):
        out = mixing.plan_mixture(df).collect()
        assert len(out) == df.count() and sorted(map(repr, out)) == sorted(map(repr, mixing.plan_mixture(df).collect()))
        size, target, taken, most = defaultdict(int), {}, defaultdict(int), defaultdict(int)
        for r in out:
            size[r.source] += r.size
            target[r.source] = r.target
            taken[r.source] += r.size * r.copies
            most[r.source] = max(most[r.source], r.size)
            assert 0 <= r.copies <= 3
        order = sorted(size, key=lambda s: (s is None, s))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        level, total = {s: 0.0 for s in size}, sum(size.values())
        open_, left = set(size), float(total)
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] > 3 * size[s]}
            if not over:
                level.update(share)
                break
            for s in over:
                level[s] = 3.0 * size[s]
                left -= level[s]
            open_ -= over
        for s in size:
            assert target[s] == pytest.approx(level[s]) and abs(taken[s] - target[s]) <= 2 * most[s]
    assert mixing.mix_digest(empty(spark)).count() == 0
    assert sorted(map(repr, mixing.mix_digest(awkward).collect())) == sorted(map(repr, mixing.mix_digest(awkward.withColumn("doc_id", F.col("doc_id").cast("int"))).collect()))
    odd = awkward.selectExpr("doc_id", "text", "source", "map(1, 2) m", "1 _rows", "'a' _id", "2 _copy")
    assert mixing.mix_documents(odd).dtypes == odd.dtypes and mixing.mix_documents(odd).count() == mixing.mix_documents(awkward).count()
    mixed = mixing.mix_documents(awkward)
    assert mixed.columns == awkward.columns and mixed.count() == sum(r.copies for r in out)


# Language ID, toxicity: held-out accuracy


def test_languages_are_told_apart(spark, awkward):
    rng = random.Random(5)
    words = {"en": "the and of with house water", "de": "der und von mit haus wasser straße", "fr": "le et avec maison eau été où"}
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=25)), lang, "s") for i in range(300) for lang in [rng.choice(list(words))]]
    df = docs(spark, rows).unionByName(awkward.where("doc_id in (2, 3, 7, 8)").replace(7, 1007, "doc_id"))
    out = {r.doc_id: r for r in langid.language_digest(df).collect()}
    truth = {i: lang for i, _, lang, _ in rows}
    held = [i for i in truth if out[i].held_out and i > 8]
    assert held and all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held)
    assert sum(out[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert out[1007].lang_pred == "und" and out[1007].score == 0 and all(0 <= r.score <= 1 for r in out.values())
    assert langid.language_digest(empty(spark)).count() == 0
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and 1007 not in {r.doc_id for r in kept.collect()} and kept.select("score").distinct().count() == 1


def test_toxic_words_are_learned(spark, awkward):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in "bdfgklm" for b in ("ado", "eri", "umo", "ito")]
    rows = [(i, " ".join(rng.choices(plain, k=30) + (rng.sample(["vilword", "crud0", "hatemob"], 2) if i % 4 == 0 else [])), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity_digest(docs(spark, rows), labels).collect()}
    held = [i for i in out if out[i].held_out]
    assert sum(out[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity.toxicity_digest(awkward, labels.limit(0)).where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity_digest(empty(spark), labels).count() == 0


def test_folding_words_and_exceptions():
    found = toxicity.automaton({"trash": 2.0, "stupid": 3.0}, ("trash can",))
    weigh = lambda t: toxicity.matched_weight(toxicity.fold(t), found)
    assert weigh("7rash, STUP1D ѕtuріd") == (8.0, 3)
    assert weigh("a trash can and trashy") == (0, 0) and weigh("trash trash can") == (2.0, 1)


# Licenses


def test_license_rules_suppress_contained_places(spark, awkward):
    rows = [(1, "Licensed under the Apache License, Version 2.0. MIT license mit LICENSE", "en", "a"), (2, "SPDX-License-Identifier: GPL-3.0-only", "en", "a"),
            (3, "GNU General\nPublic-License v3, and the general public license", "en", "a"), (4, "MIT licenseé; Kit license", "en", "a")]
    out = {r.doc_id: r for r in licenses.license_digest(docs(spark, rows)).collect()}
    assert (out[1].base_labels, out[1].labels, out[1].n_base, out[1].first_word, out[1].last_word) == ("apache,mit", "apache,apache-2.0,mit", 3, 3, 10)
    assert (out[2].labels, out[2].n_base, out[2].first_word, out[2].score) == ("gpl-3.0", 0, None, 0.95)
    assert (out[3].base_labels, out[3].n_base, out[3].first_word, out[3].last_word) == ("gpl", 2, 1, 7)
    assert (out[4].labels, out[4].n_base, out[4].n_words) == ("", 0, 4)
    assert len(licenses.rules()) > 200
    odd = licenses.scan_licenses(docs(spark, rows).selectExpr("doc_id", "text", "1.5 score", "'q' labels", "7 _found", "8 `a.b`"))
    assert odd.columns == ["doc_id", "text", "_found", "a.b", *licenses.ADDED] and {r.labels for r in odd.collect()} == {r.labels for r in out.values()}
    more = licenses.license_digest(awkward)
    assert more.count() == awkward.count() and more.where("doc_id = 2 and n_words = 0 and labels = '' and score = 0").count() == 1
    assert licenses.license_digest(empty(spark)).count() == 0


def brute_places(text):
    """(word, label) of each base phrase among a text's words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {tuple(p.split()): label for label, p in licenses.BASE.items()}
    return words, [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]


def brute_detections(text):
    """All places of all rules by Python's regular expressions, and what containment leaves of them."""
    joined = " " + " ".join(brute_places(text)[0]) + " "
    found = set()
    for label, _, priority, pattern in licenses.rules():
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", joined):
            start = joined.count(" ", 0, m.start()) - 1
            found.add((start, start + m[0].count(" ") + 1, priority, label))
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1] and (y[2] > x[2] or y[2] == x[2] and y[1] - y[0] > x[1] - x[0])
    return found, {x for x in found if not any(inside(x, y) for y in found)}


def test_licenses_match_brute_force(spark):
    rng = random.Random(12)
    bits = ["MIT License", "Apache License", "version 2.0", "General Public License", "GNU", "licensed under the", "SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier:", "GPL-3.0-only",
            "All rights reserved", "Copyright (c) 2019 - 2021", "public domain", "is in the public domain", "without warranty of any kind", "BSD 3-Clause License", "Creative Commons Attribution 4.0", "foo", "é", "v2", "lesser"]
    rows = [(i, rng.choice([" ", "\n", " - "]).join(rng.choices(bits, k=rng.randint(0, 14))), "en", "a") for i in range(120)]
    seen = 0
    for r in licenses.scan_licenses(docs(spark, rows)).collect():
        words, places = brute_places(r.text)
        found, kept = brute_detections(r.text)
        starts, base = [i for i, _ in places], sorted({label for _, label in places})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(base)) and (r.first_word, r.last_word) == (min(starts, default=None), max(starts, default=None))
        assert {(d.start, d.end, d.priority, d.label) for d in r.detections} == found and len(r.detections) == len(found)
        assert r.labels == ",".join(sorted({x[3] for x in kept} | set(base)))
        seen += len(found)
    assert seen > 300


def test_many_places_take_time_in_proportion(spark):
    text = docs(spark, [(1, "mit license " * 40_000, "en", "a")])
    out = licenses.license_digest(text).first()
    assert (out.n_base, out.first_word, out.last_word, out.labels) == (40_000, 0, 79_998, "mit")


# Media


def test_media_round_trip(spark, awkward):
    seen = defaultdict(set)
    for (i, t), r in zip(sorted(texts(awkward), key=repr), sorted(media.media_digest(awkward).collect(), key=lambda r: repr((r.doc_id, next(t for j, t in texts(awkward) if j == r.doc_id)))), strict=True):
        payload = media.padded(t)
        assert r.doc_id == i and len(payload) % 64 == 0 and payload.startswith((t or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.wav(media.MULAW, payload)
        assert media.read_wav(stored)[3] == payload and r.media_sha256 == hashlib.sha256(stored).hexdigest() and r.media_bytes == len(stored)
        seen[t or ""].add(r.feature)
    assert all(len(f) == 1 for f in seen.values())
    assert media.media_digest(empty(spark)).count() == 0


def test_codecs():
    assert media.MULAW_PCM[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and media.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 36), dtype=np.uint8)
    for block, fast in zip(blocks, media.decode_adpcm(blocks), strict=True):
        value, index = int.from_bytes(block[:2].tobytes(), "little", signed=True), min(int(block[2]), 88)
        slow = [value]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.INDEX_CHANGES[code & 7])))
                slow.append(value)
        assert slow == fast.tolist()


def test_expanding_audio(spark):
    files = [(1, media.wav(media.ALAW, b"\x55\xd5" * 8)), (2, media.wav(media.ADPCM, bytes(72), block=36)), (3, b"none"), (4, None)]
    out = {r.id: r for r in media.expand_audio(spark.createDataFrame([(i, bytearray(m) if m else None) for i, m in files], "id long, media binary")).collect()}
    assert [out[i].codec for i in (1, 2, 3, 4)] == [6, 17, None, None]
    tag, rate, _, data = media.read_wav(bytes(out[1].pcm))
    assert (tag, rate, len(data)) == (media.PCM, 16000, 64)


# SimHash


def test_simhash_components(spark, awkward, monkeypatch):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)} | {0, 1, (1 << 64) - 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    expected = {(a, b) for n, a in enumerate(signed) for b in signed[n + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for hot in (1000, 3):
        assert {tuple(r) for r in simhash.near_pairs(table, hot=hot).collect()} == expected
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_digest(awkward).collect()}
    for i, t in texts(awkward):
        assert (i, f"{simhash.fingerprint(t) & (1 << 64) - 1:016x}") in got
    assert got[12, f"{simhash.fingerprint('éèê ' * 30) & (1 << 64) - 1:016x}"] == 11 and got[3, "0" * 16] == 2 and got[7, "0" * 16] == 2
    assert simhash.simhash_digest(empty(spark)).count() == 0
    assert {r.doc_id for r in simhash.drop_near_duplicates(awkward).collect()}.isdisjoint({3, 7, 12})


def test_the_pipeline_keeps_one_of_each_simhash_component(spark, awkward):
    ids = [r.component_id for r in simhash.near_duplicates(awkward.where("doc_id is not null")).select("component_id").distinct().collect()]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(awkward.where("doc_id is not null")).collect()) == sorted(ids)
    mixed = " ".join(f"w{i}" for i in range(400))
    rows = [(None, mixed), (None, mixed.upper()), (3, "x y z"), (3, "X y  z"), (3, "other words here now"), (4, None), (9, " ")]
    out = simhash.drop_near_duplicates(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, FP string").repartition(3))
    assert out.columns == ["doc_id", "text", "FP"]
    assert sorted((r.doc_id or 0, simhash.fingerprint(r.text)) for r in out.collect()) == sorted((i or 0, simhash.fingerprint(t)) for i, t in (rows[0], rows[2], rows[4], rows[5]))


def test_simhash_broadcasts_no_table_that_grows(spark):
    rng = random.Random(9)
    few = [" ".join(str(rng.getrandbits(20)) for _ in range(4)) for _ in range(2000)]
    size = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(size)
    spark.conf.set(size, "2m")  # the smallest table is 1 MB; the probes of 2000 fingerprints are 40 MB, 200,000 copies over 4 MB
    try:
        table = spark.createDataFrame([(simhash.fingerprint(t),) for t in few], "fp long").distinct()
        assert simhash.near_pairs(common.stage(table, "fps")).count() == 0
        docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("one text of copies").alias("text")).union(spark.createDataFrame(enumerate(few, 200_000), "doc_id long, text string"))
        assert docs.count() == simhash.simhash_digest(docs).count() == 202_000
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()) == [0, *range(200_000, 202_000)]
    finally:
        spark.conf.set(size, before)


def test_fingerprint_by_hand():
    import xxhash

    words = "a b c d".split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(2)]
    assert simhash.fingerprint("A\tb  C\nd") & (1 << 64) - 1 == h[0] & h[1]
    assert simhash.fingerprint("one") & (1 << 64) - 1 == xxhash.xxh64_intdigest("one", 42)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5), (300, 300)]
    out = {r.node: r.component for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {**dict.fromkeys([*range(1, 41), 100], 1), 200: 200, 201: 200}


# Nearest neighbours


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12, 24))[rng.integers(0, 12, 1500)] + 0.5 * rng.standard_normal((1500, 24))
    x[20] *= 10
    x[40:75] = x[20]
    rows = [(i, v.tolist(), 0.1) for i, v in enumerate(x)] + [(2000, None, 0.1), (2020, [0.0] * 24, 0.1), (2040, [float("nan")] * 24, 0.1), (2060, [1.0], 0.1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = defaultdict(list)
    for r in ann.nearest_digest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    found = 0
    for q, rows in got.items():
        scores = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(scores, 9))) if i != q][:20]
        assert len(rows) == 20 and q not in dict(rows) and all(abs(s - scores[i]) < 1e-9 for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        found += len(set(order) & set(dict(rows)))
    assert found >= 0.9 * 20 * len(got)
    assert [i for i, _ in got[20]] == list(range(40, 60))
    few = ann.nearest_digest(table.where("vec_id < 5")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.nearest_digest(table.where("vec_id >= 2000 and vec_id < 2060")).count() == 0


def test_an_index_finds_all_codes_within_a_radius():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 20)) * rng.uniform(0.5, 1, (1500, 1))
    codes = ann.Codes(x[:400], float(np.sqrt((x * x).sum(axis=1).max())), 5)
    index, bits = ann.Index(codes, x), codes.planes(x, False) > 0
    for q in rng.standard_normal((8, 20)):
        planes = codes.planes(q[None], True)[0]
        flips = bits != (planes > 0)
        parts = (flips * np.abs(planes)).reshape(len(x), ann.PARTS, ann.WIDTH).sum(axis=2)
        for reach, radius in ((0.0, ann.BITS), (codes.reach, codes.radius), (2 * codes.reach, codes.radius + 40)):
            table = (parts <= reach).any(axis=1)
            near, touched = index.within(planes, reach, radius)
            assert near.tolist() == np.flatnonzero(table & (flips.sum(axis=1) <= radius)).tolist() and touched == table.sum()
            within = parts.sum(axis=1) <= ann.PARTS * reach  # pigeonhole: all of these are in some table's ball
            assert not (within & ~table).any()
        assert len(index.grown(planes, 0.0, 0, 21)) >= 21 and len(index.grown(planes, 0.0, 0, 5000)) == 1500


def test_nearest_takes_integer_ids_and_clashing_columns(spark):
    x = np.random.default_rng(3).standard_normal((60, 70))
    table = spark.createDataFrame([(i, v.tolist(), i, 0, 1.0) for i, v in enumerate(x)], "vec_id int, embedding array<float>, class_id int, rank int, score double")
    got = ann.nearest_digest(table).collect()
    assert len(got) == 3 * 20 and {r.query_id for r in got} == {0, 20, 40}
