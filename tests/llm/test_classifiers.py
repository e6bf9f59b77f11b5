import zlib

import numpy as np
import pytest

from riskloom.llm import quality_cnn, queries, sampling, toxicity_crf

from ..conftest import SF_MID


def area(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("query, label, folds, held", [(queries.op5_toxicity, "toxic", 4, 2), (queries.op8_quality, "quality", 5, 0)])
def test_held_out_accuracy(spark, query, label, folds, held):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = query(spark, SF_MID).collect()
    assert len(rows) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    y, s = np.array([a for a, _ in out]), np.array([b for _, b in out])
    assert area(y, s) > 0.9


def table(spark, documents):
    good = [(i, f"This is a quiet sentence about garden number {i}, and it goes on calmly.") for i in range(300)]
    bad = [(1000 + i, f"You moron and loser {i}, you filthy scum! Go away now.") for i in range(300)]
    docs = documents([*good, *bad, (5000, None), (5001, ""), (5002, "x" * 200000), (5003, "moron scum"), (5003, "moron scum"), (None, "calm sentence")])
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(None, 1, 0), (5000, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_toxic_words_offsets_and_odd_rows(spark, documents):
    docs, labels = table(spark, documents)
    rows = toxicity_crf.classify(docs.withColumnRenamed("lang", "score").withColumnRenamed("source", "y"), labels).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    text = {r.doc_id: r.text for r in docs.collect()}
    found = {text[1007][s.start:s.end].lower() for s in got[1007].spans}
    assert any("moron" in f for f in found) and got[1007].predicted == 1 and got[5003].predicted == 1
    assert got[7].predicted == 0 and got[7].spans == [] and got[5000].spans == [] and got[5000].score == got[5001].score
    assert [r.score for r in rows if r.doc_id == 5003][0] == [r.score for r in rows if r.doc_id == 5003][1]


def test_offsets_count_code_points(spark, documents):
    docs, labels = table(spark, documents)
    field = toxicity_crf.train(docs, labels)
    odd = "\U0001f600 é moron ñ scum"
    got = {r.doc_id: r for r in toxicity_crf.tag(documents([(1, "first text"), (2, odd)]).coalesce(1), field).collect()}[2]
    found = [odd[s.start:s.end] for s in got.spans]  # the field may tag the word between two
    assert found[0].startswith("moron") and found[-1].endswith("scum")


def test_quality_odd_rows_and_no_labels(spark, documents):
    docs, labels = table(spark, documents)
    rows = quality_cnn.classify(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and got[5000].score == got[5001].score
    assert np.mean([got[i].predicted for i in range(300)]) > 0.95 and np.mean([got[1000 + i].predicted for i in range(300)]) < 0.05
    none = labels.where("false")
    assert {r.score for r in quality_cnn.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity_crf.classify(docs, none).collect()} == {0.0}
    assert {r.score for r in quality_cnn.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality_cnn.classify(documents([]), labels).collect() == []


def test_scores_depend_on_the_text_alone(spark, documents):
    docs, labels = table(spark, documents)
    model = quality_cnn.train(docs, labels)
    rows = [(i, f"text {i} " * (i + 1)) for i in range(60)]
    together = {r.doc_id: r.score for r in quality_cnn.score(documents(rows).coalesce(1), model).collect()}
    apart = {r.doc_id: r.score for r in quality_cnn.score(documents(rows[::-1]).repartition(7), model).collect()}
    assert all(abs(together[i] - apart[i]) < 1e-5 for i in together)


def test_held_out_rows_and_conflicts_never_train(spark, documents):
    docs = documents([(i, str(i)) for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(1, 0)], "doc_id bigint, quality int")
    ids = {r.doc_id for r in sampling.training_rows(docs, labels, "quality", 5, 0, 1000).collect()}
    assert ids == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 0 and i != 1}


def test_rows_of_one_id_train_once(spark, documents):
    docs = documents([(1, f"text {i}") for i in range(3000)] + [(2, "other"), (3, None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)] * 5, "doc_id bigint, quality int")
    rows = sampling.training_rows(docs, labels, "quality", 5, 6, 10).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3]
    again = sampling.training_rows(docs.repartition(5), labels, "quality", 5, 6, 10).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_long_lines_train_in_pieces(spark, documents):
    line = "you filthy scum go away now " * 400
    assert all(len(p) <= 2048 for p in toxicity_crf._pieces(line)) and "".join(toxicity_crf._pieces("x" * 5000)) == "x" * 5000
    assert " ".join(p.strip() for p in toxicity_crf._pieces(line)).split() == line.split()
    rng = np.random.default_rng(1)

    def one_line(i, insult):  # of its own words, so that none is a copy of another
        words = rng.choice([f"calm{j}" for j in range(3000)], 1500)
        words[::25] = "moron" if insult else "garden"
        words[7::50] = "scum" if insult else "quiet"
        return " ".join(words)

    docs = documents([(i, one_line(i, True)) for i in range(300)] + [(1000 + i, one_line(i, False)) for i in range(300)])
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000 + i, 0) for i in range(300)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity_crf.classify(docs, labels).collect()}
    assert np.mean([got[i] for i in range(300)]) > 0.9 and np.mean([got[1000 + i] for i in range(300)]) < 0.1
