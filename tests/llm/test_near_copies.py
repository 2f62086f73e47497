"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import numpy as np

from tallyweave.llm import near_copies


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, own, n):
    own = list(own)
    for at in rng.sample(range(len(own)), n):
        own[at] = f"new{rng.randrange(10**6)}"
    return " ".join(own)


def corpus():
    """(doc_id, text): exact copies, near copies on both sides of 0.8, a chain, a group of 60 and shared boilerplate."""
    rng = random.Random(5)
    out, boiler = [], words(rng, 30)
    for _ in range(30):
        base = words(rng, rng.randint(40, 300))
        out += [" ".join(base), " ".join(base).upper()] + [changed(rng, base, max(1, round(share * len(base)))) for share in (0.005, 0.01, 0.02, 0.03, 0.05)]
    out += [changed(rng, boiler + words(rng, rng.randint(1, 60)), 1) for _ in range(40)]
    group = words(rng, 200)
    out += [changed(rng, group, 2) for _ in range(60)]
    chain = words(rng, 120)
    for _ in range(8):
        out.append(" ".join(chain))
        chain = chain[6:] + words(rng, 6)
    out += ["short", "Short ", "two words", "", "  ", None]
    rng.shuffle(out)
    return list(enumerate(out))


def runs(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """Sets of row numbers, closed over pairs with a Jaccard similarity of 0.8 or more."""
    sets, part = [runs(text) for _, text in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    return [[n for n, p in enumerate(part) if p == q] for q in set(part)]


def test_near_copies_match_brute_force(spark, monkeypatch):
    rows = corpus()
    expected = sorted(min(g) for g in groups(rows))
    assert len(expected) < len(rows) - 150
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == expected
    monkeypatch.setattr(near_copies, "hot_shingles", lambda docs: np.sort(np.concatenate([near_copies.shingles(t) for _, t in rows[::3]])))
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == expected
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_heads_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 10**6, int(rng.integers(1, 60))))
        b = np.unique(np.append(a[rng.random(len(a)) < 0.9], rng.integers(0, 10**6, int(rng.integers(0, 4)))))
        hot = np.sort(rng.choice(a, len(a) // 3, replace=False))
        if len(b) and near_copies.similar(a, b):
            assert set(near_copies.head(a, hot)) & set(near_copies.head(b, hot))


def test_one_row_of_each_group_whatever_its_id(spark):
    rng = random.Random(6)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [
        (None, " ".join(a)), (None, changed(rng, a, 1)), (None, "alone without an id"),  # groups of null ids only
        (5, " ".join(b)), (5, " ".join(b)), (6, " ".join(b)), (None, " ".join(b)),  # repeated rows
        (7, " ".join(c)), (2, changed(rng, c, 1)), (7, " ".join(d)), (1, changed(rng, d, 1)), (7, "another text of seven"),  # one id, several groups
        (None, None), (9, ""), (9, ""),
    ]
    out = [(r.doc_id, r.text) for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(out) == len(set(out)) == len(groups(rows))
    for group in groups(rows):
        own = [rows[n] for n in group]
        kept = [r for r in out if r in own]
        assert len(kept) == 1
        assert kept[0][0] == min((i for i, _ in own if i is not None), default=None)
