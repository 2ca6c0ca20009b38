"""The set join against comparing all pairs."""

import random
import re

import numpy as np
import pytest

from macrospark.llm import set_join as J

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j]) if s else 0
            if both and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return out


def rows_of(got):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted((tuple(r) for r in got), key=key)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


def awkward(seed):
    """Texts of all sizes with copies around the limit, chains of small steps, a passage shared by unlike texts, special rows."""
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        base = [f"b{k}w{i}" for i in range(rng.choice([1, 4, 5, 6, 8, 9, 12, 20, 35, 60, 120, 300]))]
        for _ in range(4):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 6]))))
            if rng.random() < 0.4:
                rows.append(" ".join(base[:max(1, int(len(base) * rng.choice([0.8, 0.81, 0.85, 0.9])))]))
    passage = " ".join(f"p{i}" for i in range(120))
    rows += [passage + " " + " ".join(f"u{k}x{i}" for i in range(rng.choice([10, 24, 26, 31, 60, 160]))) for k in range(60)]
    chain = [f"c{i}" for i in range(90)]
    for _ in range(30):
        chain = edited(rng, chain, 1)
        rows.append(" ".join(chain))
    rows += ["", None, " \n", "One TWO", "one two", "x " * 500, ("y " * 5000) + "z", rows[0], rows[0]]
    ids = [*range(len(rows) - 4), None, None, 7, 7]
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_by_brute_force(spark, seed):
    rows = awkward(seed)
    got = J.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert rows_of(got) == rows_of(brute(rows))


def test_frequent_features_change_nothing(spark, monkeypatch):
    rows = awkward(3)
    monkeypatch.setattr(J, "RUN_LEAST", 2)
    monkeypatch.setattr(J, "HEAVY_LEAST", 3)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `set` string, size int").repartition(3)
    assert len(J.sketches(docs)[1].items) > 100
    assert rows_of(J.digest(docs).collect()) == rows_of(brute(rows))


@pytest.mark.parametrize("bits", [3, 8])
def test_sets_that_share_a_short_name(spark, monkeypatch, bits):
    rows = awkward(4)
    monkeypatch.setattr(J, "NAME_BITS", bits)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(J.digest(docs).collect()) == rows_of(brute(rows))


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (0, 1, 5, 63, 64, 65, 500, 512, 513, 3000, 0)]
    sets += [np.unique(np.concatenate([s[len(s) // 9:], rng.integers(0, 1 << 63, len(s) // 20).astype(np.uint64)])) for s in sets[3:10]]
    odd = J.parities(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    some = [i for i, s in enumerate(sets) if len(s)]
    pairs = [(i, j) for i in some for j in some]
    found = J.differences(odd.take([i for i, _ in pairs]), odd.take([j for _, j in pairs]))
    for (i, j), bits in zip(pairs, found):
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert bits <= apart and (bits - apart) % 2 == 0
        if min(len(sets[i]), len(sets[j])) >= max(500, 0.8 * max(len(sets[i]), len(sets[j]))) and apart > 0.4 * (len(sets[i]) + len(sets[j])):
            assert 9 * bits > len(sets[i]) + len(sets[j])  # ruled out


def test_sets_of_unlike_texts_do_not_travel(spark, monkeypatch):
    """Texts that share a passage meet in buckets, and share first features; their sets are not sent to be compared."""
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(k, passage + " " + " ".join(f"u{k}x{i}" for i in range(100))) for k in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1] + " more"), (102, " ".join(rows[1][1].split()[3:]))]
    sent, whole = [], J.similar
    monkeypatch.setattr(J, "similar", lambda docs, pairs: sent.append(pairs.count()) or whole(docs, pairs))
    assert rows_of(J.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()) == rows_of(brute(rows))
    assert 2 <= sum(sent) <= 10


def test_similar_sets_share_signatures():
    """Every pair at the limit of similarity has a signature in common, with or without frequent features, whatever the features are."""
    rng = np.random.default_rng(7)
    for n in (4, 5, 7, 9, 13, 18, 28, 45, 90, 200, 500):
        for _ in range(60):
            universe = rng.integers(0, 1 << 63, 2 * n + 10).astype(np.uint64)
            a = universe[:n]
            lost = int(rng.integers(0, n // 5 + 1))  # of a; so many are new in b that the pair is similar still
            new = max(0, (n - lost) * 5 // 4 - n)
            b = np.concatenate([a[lost:], universe[n:n + new]])
            both = n - lost
            assert 5 * both >= 4 * (n + len(b) - both)
            some = np.unique(rng.choice(universe, int(rng.integers(0, len(universe)))))
            heavy = J.Frequent(some, rng.permutation(len(some)) + 1)
            runs = np.concatenate([np.sort(a), np.sort(b)])
            sigs, of = J.signatures(runs, np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), heavy.of(runs))
            assert lost + new == 0 or set(sigs[of == 0].tolist()) & set(sigs[of == 1].tolist()), (n, lost, new)


def test_empty(spark):
    assert J.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
