"""Grid codes against plain nearest neighbours, and their defined results for special rows."""

import hashlib

import numpy as np
import pytest

from macrospark.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=V.ROUNDS):
    """vec_id -> (code, error), and the codebooks' checksum, by comparing with every entry."""
    good = sorted(((r[0], r[1]) for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    ints = np.floor(np.array([v for _, v in good], np.float32).astype(float) * 1024).astype(np.int64)
    width = ints.shape[1] // 4
    books, codes, errors = [], [], []
    for p in range(4):
        part = ints[:, p * width:(p + 1) * width]
        book = part[:256].copy()
        for k in range(rounds + 1):
            far = ((part[:, None] - book[None]) ** 2).sum(2)
            at = far.argmin(1)
            if k < rounds:
                for e in range(len(book)):
                    if (at == e).any():
                        book[e] = part[at == e].sum(0) // (at == e).sum()
        books.append(book), codes.append(at), errors.append(far.min(1))
    text = ",".join(str(x) for b in books for x in b.reshape(-1).tolist())
    return {i: ("".join(f"{c[k]:02x}" for c in codes), int(sum(e[k] for e in errors))) for k, (i, _) in enumerate(good)}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("cell", [8, 64, 4096])
def test_codes_by_brute_force(spark, monkeypatch, cell):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)], int(i % 3) if i % 5 else None) for i in range(700)]
    rows += [(1000 + i, rows[9][1], 1) for i in range(200)]  # a crowd of equal vectors
    rows += [(-1, None, 0), (-2, [None] * 8, 0), (-3, [float("nan")] * 8, 0), (-4, [float("inf")] + [0.0] * 7, 0), (-5, [], 0), (9000, [1.0], 0)]
    monkeypatch.setattr(V, "CELL", cell)
    monkeypatch.setattr(V, "PAIRS", 5000)
    got = V.digest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want, sha = brute([r for r in rows if r[0] != 9000])
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {sha}
    label = {i: x for i, _, x in rows}
    for x in (None, 0, 1, 2):
        assert {r["label_error"] for r in got if label[r["vec_id"]] == x} == {sum(e for i, (_, e) in want.items() if label[i] == x)}


def test_ties_and_floors():
    memo = V.Memo(np.array([[4, 0], [0, 0], [4, 0]]))
    at, error = memo.nearest(np.array([[4, 0], [2, 0], [-1, 0]]))
    assert at.tolist() == [0, 0, 1] and error.tolist() == [0, 4, 1]
    assert V.whole_numbers(np.array([-0.0001, 1e30])).tolist() == [-1, V.MOST]


def test_special_tables(spark):
    assert V.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, [0.5, 0.5, 0.5, 0.5], None), (2, [0.5, 0.5, 0.5, 0.5], None), (2, [0.25, 0.5, 0.5, 0.5], 1)]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", code string, _label int")
    got = V.digest(extra).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == [(0, "01000000", 0, 0), (2, "00000000", 0, 0), (2, "01000000", 0, 0)]
