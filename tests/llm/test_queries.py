"""Registered corpus queries: against SQL where there is some, and over empty and awkward tables."""

import pytest

from corpus_pipeline import STAGES, run
from macrospark.llm import licenses as L
from macrospark.llm.queries import QUERIES
from tests.compare import compare, connect
from tests.conftest import SF


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, name):
    assert compare(QUERIES[name].run(spark, SF), connect(SF), QUERIES[name].sql) == "ok"


def _tables(spark, corpus, path, empty=False):
    keep = (lambda df: df.limit(0)) if empty else (lambda df: df)
    keep(corpus).write.parquet(f"{path}/documents.parquet")
    keep(spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (2, None), (3, ""), (3, "?!")], "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    keep(spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")).write.parquet(f"{path}/labels.parquet")
    keep(spark.createDataFrame([(1, "http://a.b.com/en/1", "<html lang=en>w1 w2 w3"), (2, None, None), (None, "x", ""), (3, "//h", "<script>unclosed")],
                               "page_id long, url string, html string")).write.parquet(f"{path}/pages.parquet")
    keep(spark.createDataFrame([(1, [0.5] * 8, 1), (2, None, None), (None, [0.25] * 8, None), (4, [float("nan")] * 8, 1), (5, [0.5] * 8, 1), (5, [0.5] * 8, None)],
                               "vec_id long, embedding array<float>, label int")).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_tables(spark, corpus, tmp_path, name):
    got = QUERIES[name].run(spark, _tables(spark, corpus, tmp_path / "t")).collect()
    assert len(got) == {"op8": 4, "op12": 4, "op13": 3000}.get(name.split("_")[0], corpus.count())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, corpus, tmp_path, name):
    assert QUERIES[name].run(spark, _tables(spark, corpus, tmp_path / "t", empty=True)).collect() == []


def test_pipeline(spark, corpus, tmp_path):
    path = _tables(spark, corpus, tmp_path / "t")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, path).write.parquet(f"{path}/stage-{k}")  # written and read again, as in a run
        left = spark.read.parquet(f"{path}/stage-{k}")
        assert left.columns == docs.columns and left.count() > 0
        docs = left
    rows = STAGES[-1][1](spark, docs, path).collect()
    assert len(rows) == docs.count() > 0
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert run(spark, _tables(spark, corpus, tmp_path / "e", empty=True)).count() == 0


def test_near_dedup_reaches_similarity(spark, tmp_path):
    """One changed word in thirty leaves five-word sets about 0.8 alike or more: the stage drops such copies."""
    words = [[f"d{d}w{i}" for i in range(150)] for d in range(30)]
    rows = [(d, " ".join(w)) for d, w in enumerate(words)] + [(100 + d, " ".join(["new", *w[1:70], "new", *w[71:]])) for d, w in enumerate(words)]
    stage = dict(STAGES)["near dedup"]
    left = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(30))


def test_rows_without_id_stand_for_themselves(spark, tmp_path):
    """Rows without doc_id, or that share one, are judged each by its own text in every stage and digest."""
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9"
    good = lambda k: " ".join(f"g{k}x{i}" for i in range(80))
    rows = [(d, t, "en", "s", 0) for d in (None, 7) for t in (good(f"{d}a"), good(f"{d}b"), f"{good(f'{d}c')} {item}", "short")]
    rows += [(None, good("both"), "en", "s", 0), (9, good("both"), "en", "s", 0)]
    path = str(tmp_path / "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    stages = dict(STAGES)
    left = lambda name: sorted((r["doc_id"] or 0, r["text"]) for r in stages[name](spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect())
    every = sorted((d or 0, t) for d, t, *_ in rows)
    assert left("quality rules") == [x for x in every if x[1] != "short"]
    assert left("decontamination") == [x for x in every if item not in x[1]]
    assert left("near dedup") == [x for x in every if x != (0, good("both")) and x != (0, "short")]
    assert left("source mix") == every
    got = QUERIES["op10_edit_windows"].run(spark, path).collect()
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in got) == sorted((d, item in t) for d, t in every)


def test_licences_of_rows_without_id(spark):
    rows = [(None, "Released under the MIT License.", "en"), (None, "plain words only", "en"), (1, "Released under the ISC License.", "en"), (1, "more plain words", "en")]
    got = L.digest(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")).collect()
    assert sorted((r["doc_id"] or 0, r["licences"] or "", r["n_notices"]) for r in got) == sorted([(0, "mit", 1), (0, "", 0), (1, "isc", 1), (1, "", 0)] * 2)


def test_stages_take_columns_of_any_name(spark, tmp_path):
    """The user's own _id, _mark, _rows, _times, _doc, _rank and mark come through every stage but the last unchanged."""
    names = ["_id", "_mark", "_rows", "_times", "_doc", "_rank", "mark", "set"]
    text = lambda k: " ".join(f"g{k}x{i}" for i in range(80))
    rows = [(d, text(k), "s", *[k] * len(names)) for k, d in enumerate([1, 2, None, None, 5, 5])] + [(7, text(0), "s", *[9] * len(names))]
    path = str(tmp_path / "t")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    spark.createDataFrame([(1, "nothing of this stands there at all today")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, path).write.parquet(f"{path}/stage-{k}")
        docs = spark.read.parquet(f"{path}/stage-{k}")
        assert docs.columns == ["doc_id", "text", "source", *names]
    assert sorted((r["doc_id"] or 0, r["_id"], r["mark"]) for r in docs.collect()) == [(0, 2, 2), (0, 3, 3), (1, 0, 0), (2, 1, 1), (5, 4, 4), (5, 5, 5)]
