import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts over a small vocabulary: copies, near copies, shared passages, nulls, empties, a long text, repeated rows."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).replace(" w7", "\nw7")
    passage = text(30)
    rows = [(i, text(rng.choice([3, 40, 90, 200]))) for i in range(60)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    for i in range(20):
        words = rows[i + 10][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((200 + i, " ".join(words)))
    rows += [(300 + i, text(20) + " " + passage + "\n" + text(15)) for i in range(10)]
    rows += [(400, text(3000)), (401, "w1 " * 500), (402, ""), (403, None), (404, " \n\t"), (405, "  café 中文 \U0001f600 " * 20)]
    rows += [(None, passage), (None, passage), (None, None), (10, rows[10][1]), (10, rows[10][1])]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if (i or 1) % 9 else None, 0) for i, t in rows], SCHEMA).coalesce(3).cache()
