"""The pipeline's stages on a small corpus, and the queries' names."""

import random
import re

import corpus_pipeline
from weft.llm import queries

WORDS = [f"{a}{b}" for a in ("al", "be", "co", "du", "el", "fa", "go", "hu") for b in ("ra", "mi", "so", "tu", "ne", "vo", "ki")]


def corpus(spark, path):
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, labels, bad, dirty = [], [], set(), set()
    items = [(k, prose(30)) for k in range(4)]
    for i in range(160):
        text = prose(rng.randint(60, 120))
        if i % 8 == 0:
            text, _ = text.upper().replace(" ", "!! "), bad.add(i)
        elif i % 16 == 3:
            text, _ = f"{text} {items[i % 4][1]} {prose(10)}", dirty.add(i)
        rows.append((i, text))
        if i < 120:
            labels.append((i, int(i % 8 != 0), 0))
    copies = {200: 1, 201: 1, 202: 2}
    rows += [(k, rows[v][1].replace(" ", "  ", 3)) for k, v in copies.items()]
    near = {210: 4, 211: 5}
    for k, v in near.items():
        words = rows[v][1].split()
        words[7] = "changed"
        rows.append((k, " ".join(words)))
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {i: t for i, t in rows}, bad, dirty, copies, near


def test_stages(spark, tmp_path):
    texts, bad, dirty, copies, near = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = [bad, set(copies), set(near), dirty]
    left = set(texts)
    for (name, stage), lost in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left -= lost
        assert {r["doc_id"] for r in docs.collect()} == left, name
    want = {i: len(re.findall(r"\S+", texts[i])) for i in left}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in packed} == want
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, packed))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.SQL) == {"op5_exact_dedup", "op6_line_dedup", "op7_secret_scan"}
