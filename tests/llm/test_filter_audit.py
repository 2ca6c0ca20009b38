"""The filter audit against counting row by row."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from macrospark.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    marked = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                             bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t])) if x}
        marked[s or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, docs in marked.items():
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone, before = [x for x in left if f in x[0]], left
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs),
                                                   sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(total[f])
    return out


def test_audit_by_brute_force(spark):
    plain = lambda k, n=60: " ".join(f"v{k}x{i}" for i in range(n))
    texts = [plain(1), plain(2), plain(2), "UPPER " * 60, "a # b", "", None, " \n", plain(3) + " 50%", plain(4).upper(), plain(5) * 40, "é" * 70000, plain(1)]
    rows = [(k, texts[k % len(texts)], ["hot", "hot", "cold", None][k % 4]) for k in range(150)]
    rows += [(None, plain(1), "hot"), (None, plain(1), "hot"), (3, plain(1), "cold"), (3, plain(1), "cold"), (500, plain(9), "lonely")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 150, 3)] + [(None, 1, 1), (3, None, None), (500, 1, 1), (500, 0, 0)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, kept int, good string").repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(docs, table).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got} == brute(rows, labels)
    assert len(got) == 4 * 600


def test_lists_by_sets():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 100, 1000):
        lists = [np.flatnonzero(rng.random(n) < p) for p in (0.01, 0.5, 0.99, 0.0, 0.1)]
        assert A.union(lists).tolist() == sorted(set().union(*[x.tolist() for x in lists]))
        for a in lists:
            for b in lists:
                assert A.difference(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
                assert A.common(a, b) == len({*a.tolist()} & {*b.tolist()})
                assert A.leaps(a, b).tolist() == np.searchsorted(a, b).tolist()


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert A.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
