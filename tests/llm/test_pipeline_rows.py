"""The near-duplicate stage decides by row, not by id."""

from collections import Counter

import corpus_pipeline
from fixtures import prose


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    a, other = prose(1, 200), prose(2, 200)
    near = a + " tail"
    rows = [(1, a), (2, near), (2, other), (None, a), (3, a), (3, a), (None, ""), (4, None), (None, prose(3, 50)), (5, prose(3, 50))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __row0 int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (2, other), (None, ""), (4, None), (5, prose(3, 50))])


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 0
