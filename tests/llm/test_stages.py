"""The pipeline's filtering stages on repeated rows, nulls, clashing columns and empty tables."""
from pyspark.sql import functions as F
from test_llm import frame, prose

from ledgerspark.llm import common, jaccard, quality


def test_keep_one_of_repeated_rows(spark):
    a, b = prose(40), prose(30)
    rows = [(1, a), (1, a), (1, a), (2, a + " x"), (3, b), (3, b.upper()), (3, prose(20)), (4, None), (4, None), (5, ""),
            (None, b), (None, b), (None, prose(9)), (None, None), (None, " "), (6, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("gone_id", "_id", "count", "words", "component_id", "node", "key"):
        df = df.withColumn(name, F.lit("clash"))
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and out.filter("key <> 'clash'").isEmpty()
    kept = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").split())) for r in out.collect())
    # one row of id 1; two texts of id 3, each once; of null ids, equal words once, those without all
    assert kept == [(False, 1, 40), (False, 3, 20), (False, 3, 30), (False, 4, 0), (False, 5, 0),
                    (True, 0, 0), (True, 0, 0), (True, 0, 9), (True, 0, 30)]
    assert jaccard.keep_one(df.limit(0)).count() == 0


def test_keep_good_keeps_columns_and_stands_odd_rows(spark):
    df, docs = frame(spark, [prose(30), None, "", prose(3), prose(3)] * 4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    out = quality.keep_good(df, labels)
    assert out.columns == df.columns and out.count() <= len(docs)
    assert quality.keep_good(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).columns == df.columns


def test_sample_bound_counts_rows(spark):
    docs = spark.createDataFrame([(k % 50, f"text {k}") for k in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 50, k % 2) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, quality int")
    every = common.labelled_sample(docs, labels, "quality", 1000).collect()
    assert len(every) == len({r.doc_id for r in every}) and all(r.text == min(f"text {k}" for k in range(r.doc_id, 500, 50)) for r in every)
    few = common.labelled_sample(docs, labels, "quality", 3).collect()
    assert len(few) == 3 and {tuple(r) for r in few} <= {tuple(r) for r in every}
