import numpy as np
from pyspark.sql import functions as F

from emberline.llm import quality_classifier as q
from tests.llm.conftest import prose


def test_held_out_accuracy_and_edge_cases(documents, spark):
    good = [prose(i, 60) for i in range(150)]
    bad = [" ".join(w + "$$$" for w in prose(1000 + i, 60).split()) for i in range(50)] + [" ".join(w for w in prose(2000 + i, 8).split() for _ in range(8)) for i in range(50)]
    texts = good + bad + [None, "", "  "]
    docs = documents(texts).withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(250) if i % 2] + [(None, 1), (7, None)], "doc_id long, quality int")
    out = q.score(docs, q.fit(docs, labels))
    assert out.columns == docs.columns
    scores = {r.doc_id: r.quality_score for r in out.collect()}
    held = [i for i in range(250) if not i % 2]
    assert np.mean([(scores[i] >= 0.5) == (i < 150) for i in held]) > 0.97
    assert scores[250] == scores[251] == scores[252] and 0 < scores[250] < 1
    kept = {r.doc_id for r in q.accepted(docs, labels).collect()}
    assert kept == {i for i, s in scores.items() if s >= q.THRESHOLD}


def test_no_labels_and_no_documents(documents, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.quality_score for r in q.score(documents(["a b"]), q.fit(documents(["a b"]), labels)).collect()] == [0.5]
    assert q.score(documents([]), q.fit(documents([]), labels)).collect() == []


def test_features_are_each_texts_own():
    import pyarrow as pa

    from emberline.llm import bytewords as bw

    texts = ["the cat sat sat", "", "x", "\n", "über  maß", "the cat sat sat"]
    raw, offsets = bw.texts(pa.array(texts))
    parts = q.features(raw, offsets)
    for i, t in enumerate(texts):
        r, o = bw.texts(pa.array([t]))
        for (a, at), (b, bt) in zip(parts, q.features(r, o)):
            assert a[at[i] : at[i + 1]].tolist() == b[bt[0] : bt[1]].tolist(), t
    n = [sum(at[i + 1] - at[i] for _, at in parts) for i in range(6)]
    # "the cat sat sat": 4 words, 4 * 3 + 4 * 2 grams of 3 and 4 with blanks, one repeat.
    assert n[0] == 4 + 4 * 3 + 4 * 2 + 8 and n[1] == n[3] == 0 and n[2] == 2


def test_rows_of_one_labelled_id_are_learned_from_once(documents, spark):
    texts = [prose(i, 40) for i in range(6)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    once = [*enumerate(texts)]
    again = once + [(0, texts[0])] * 500
    assert np.array_equal(q.fit(documents(once), labels), q.fit(documents(again), labels))
    long_ = documents([*once, (9, "word " * 200_000)])
    assert all(0 <= r.quality_score <= 1 for r in q.score(long_, q.fit(long_, labels)).collect())
