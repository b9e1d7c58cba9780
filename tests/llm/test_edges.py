"""The cases that every operator and every stage of the pipeline must take: nulls, empty and very long texts, ties, repeated rows, empty tables, and columns whose names clash."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm.decontaminate import contamination
from weft.llm.exact_dedup import exact_groups
from weft.llm.line_dedup import line_dedup
from weft.llm.lm_score import lm_scores
from weft.llm.minhash import near_duplicates
from weft.llm.packing import pack
from weft.llm.quality import quality_scores, train_quality
from weft.llm.secret_scan import scan_secrets
from weft.llm.suffix_dedup import suffix_dedup
from weft.llm.toxicity import toxicity_scores, train_toxicity

#: Names that the operators use for themselves, in other cases too, and names that need quoting.
CLASHES = """_id _ID _text _len _m0 _m1 _key _key_of _row _row_key _drop _mark_id _place _word _bits _score _y h y held text_meta _digest keep_id group_size kept
text_sha256 _b_id _b_row _b_n _b_words blob missing _todo _one have spans rules key key2 bytes runs place left right gram context class_id class_size _class _k _set _map
_buckets bucket root node piece first shard bin capacity n_tokens _target _item seed window around agree word item_id cosine evidence predicted score""".split()
ODD_NAMES = ["a.b", "with space", "tick`ed", "piece "]


def table_of(spark, rows, clashing):
    """The documents, with further columns."""
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if not clashing:
        return docs
    seen, names = {c.lower() for c in docs.columns}, []
    for c in [*CLASHES, *ODD_NAMES]:
        if c.lower() not in seen:
            seen.add(c.lower())
            names.append(c)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])


def corpus():
    rng = random.Random(77)
    words = [f"{a}{b}" for a in ("al", "be", "co", "du", "el") for b in ("ra", "mi", "so", "tu", "ne")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(40, 80))) + ("\nvenom spite" if i % 5 == 0 else "")) for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \n\t"), (None, rows[3][1]), (None, None), (43, rows[4][1]), (4, rows[4][1]), (4, rows[4][1]), (5, "another text of an id that is taken"), (44, "one")]
    rows += [(50, "same " * 200_000), (51, " ".join(f"long{k}" for k in range(100_000))), (52, "é" * 300_000)]
    return rows


LABELS = [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(24)] + [(None, 1, 1), (3, None, None), (2, 0, 0)]


def operators(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one"), (None, "long7 long8 long9 long10 long11"), (3, None), (4, "")], "item_id long, text string")
    return {
        "op1": suffix_dedup,
        "op2": near_duplicates,
        "op3": pack,
        "op4": lambda d: contamination(d, bench),
        "op5": exact_groups,
        "op6": lambda d: line_dedup(d).select("doc_id", "text", "lang", "n_lines", "n_dropped"),
        "op7": scan_secrets,
        "op8": lambda d: quality_scores(d, train_quality(d, labels)),
        "op9": lambda d: toxicity_scores(d, train_toxicity(d, labels)),
        "op10": lambda d: lm_scores(d, F.col("doc_id") % 2 == 0),
    }


@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 11)])
def test_operators_take_odd_tables(spark, name):
    """Rows come back for every input row, and neither other columns nor a second run change them."""
    run = operators(spark)[name]
    rows = corpus()
    plain = run(table_of(spark, rows, False))
    got = sorted(map(repr, plain.drop("kept" if name == "op1" else "nothing").collect()))
    if name == "op3":
        whole = {r["doc_id"]: r["n"] for r in plain.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
        assert whole[50] == 200_000 and whole[51] == 100_000 and 40 not in whole and whole[4] == 3 * len(rows[4][1].split())
    elif name == "op4":
        assert {(r["doc_id"], r["item_id"]) for r in plain.collect()} == {(44, 1), (51, None)}
    else:
        assert len(got) == len(rows)
    clashing = run(table_of(spark, rows, True))
    if name == "op3":  # shards depend on how rows are numbered; what is packed does not
        assert clashing.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).count() == len(whole)
    else:
        assert sorted(map(repr, clashing.drop("kept" if name == "op1" else "nothing").collect())) == got
    assert run(table_of(spark, [], True)).count() == 0
    assert run(table_of(spark, [(None, None)], False)).count() == (0 if name in ("op3", "op4") else 1)


@pytest.mark.parametrize("clashing", [False, True])
def test_stages_take_odd_tables(spark, tmp_path, clashing):
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus()
    docs = table_of(spark, rows, clashing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name in ("exact_dedup", "near_dedup"):
            # One row of equal texts: the smallest id, or a null one where no other is there, and no row twice.
            assert ids.count(4) == 1 and 43 not in ids and None not in ids and ids.count(40) == 1 and 41 not in ids, name
        if name == "decontaminate":
            assert sorted(map(repr, ids)) == sorted(repr(i) for i, _ in rows if i != 44)
        if clashing:
            assert all(r["_id"] == "own _id" and r["_score"] == "own _score" for r in out.select("_id", "_score").collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    """Empty tables, and a table of nulls only."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table_of(spark, [], False).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    table_of(spark, [(None, None), (None, None), (1, None)], False).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
