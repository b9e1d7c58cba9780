"""What a Python worker holds at once, and what buckets of near copies carry."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

import weft.llm.minhash as minhash
from weft.llm.common import TEXT_ROWS, staged
from weft.llm.quality import _summed
from weft.sources.store import map_arrow


def test_workers_get_few_texts_at_once(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    docs = spark.range(3 * TEXT_ROWS).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [r["n"] for r in staged(docs.transform(map_arrow, rows, "n long"), "sizes", TEXT_ROWS).collect()]
    assert sum(got) == 3 * TEXT_ROWS and max(got) <= TEXT_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_sums_take_few_rows_at_once(spark):
    def count(b, out):
        assert b.num_rows <= 1000
        out[0] += b.num_rows
        out[1] += sum(b.column("id").to_pylist())

    assert list(_summed(spark.range(2500).coalesce(1), count, 2)) == [2500, 2500 * 2499 / 2]


def test_buckets_carry_no_maps(spark, monkeypatch):
    """Three classes whose members share buckets: links are found, and tables of bucket rows have numbers and sizes only."""
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(3)]
    rows = [(3 * k + i, f"{t} tail{k}") for k in range(6) for i, t in enumerate(base)]
    seen, plain = [], minhash.staged

    def recorded(df, label, *rest):
        seen.append((label, len(df.columns)))
        return plain(df, label, *rest)

    monkeypatch.setattr(minhash, "staged", recorded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit(1))
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs, rounds=1).collect()} == {i: i % 3 for i, _ in rows}
    assert seen and all(n <= 4 for label, n in seen if label in ("buckets", "open"))
