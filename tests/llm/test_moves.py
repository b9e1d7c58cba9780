"""What near-duplicate detection moves, and that the quality scores don't depend on how rows are dealt."""

import random

import weft.llm.minhash as minhash
from weft.llm.quality import quality_scores, train_quality

WORDS = [f"w{k}" for k in range(400)]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(n)]


def test_sets_of_lone_texts_are_not_moved(spark, monkeypatch):
    rows = texts(200, 1)
    rows += [f"{rows[0]} more"]
    moved, plain = [], minhash.apart

    def counted(*args):
        out = plain(*args)
        moved.append(out[1].count())
        return out

    monkeypatch.setattr(minhash, "apart", counted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == {k: 0 if k == 200 else k for k in range(201)}
    assert moved == [2]


def test_quality_does_not_depend_on_partitions(spark):
    rows = [(k // 2 * 2 if k % 10 == 1 else k, t, "en", f"s{k % 3}") for k, t in enumerate(texts(300, 2))]
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 120)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    runs = [sorted((r["doc_id"], r["score"]) for r in quality_scores(d, train_quality(d, labels)).collect()) for d in (docs.coalesce(1), docs.repartition(3))]
    assert runs[0] == runs[1]
