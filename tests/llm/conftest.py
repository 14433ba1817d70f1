import random

import pytest
from pyspark.sql import functions as F

WORDS = "amber birch cedar delta ember flint grove heron inlet jetty kiosk lumen maple north ocean pearl quilt river stone thorn umber viola wharf xenon yield zesty".split()


def prose(rng, n):
    """n invented words, few of them twice."""
    return [rng.choice(WORDS) + rng.choice(WORDS)[:3] + rng.choice("abcdefgh") for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): plain documents, exact and near copies, shared passages, odd rows."""
    rng = random.Random(11)
    rows = [(i, " ".join(prose(rng, rng.randint(120, 260)))) for i in range(60)]
    for i in range(10):
        rows.append((100 + i, rows[i][1]))
        words = rows[20 + i][1].split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 40)):
            words[at] = prose(rng, 1)[0]
        rows.append((200 + i, " ".join(words)))
    passage = " ".join(prose(rng, 55))
    for i in range(6):
        rows.append((300 + i, " ".join(prose(rng, 80)) + ".\n" + passage.upper() + "! " + " ".join(prose(rng, 70))))
    rows += [(400, ""), (401, "word"), (402, "!!! ???"), (403, "word"), (404, "lone " * 3000), (405, "x" * 200_000), (406, " ".join(prose(rng, 30_000)))]
    return rows


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """The corpus as a table with nulls, repeated rows, and columns of clashing names."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None) for i, t in corpus]
    rows += [(None, corpus[0][1], None, "s0"), (500, None, "en", "s1"), (None, None, None, None), rows[5], rows[5]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    for name in ("h", "u", "v", "m", "pos", "part", "fp", "slot", "shard", "ref_id", "word", "_gone", "_n", "_s", "_d", "keys", "at", "n", "bytes", "mass", "rep"):
        frame = frame.withColumn(name, F.lit(name))
    return frame.withColumn("n_chars", F.length("text"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
