"""The pipeline over a small folder with hard rows: what must go goes, clean documents stay, values are hidden."""

import collections
import os

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from test_operators import prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    clean = [(i, prose(i, 80), "en", f"s{i % 3}") for i in range(60)]
    toxic = [(100 + i, prose(100 + i, 40) + " moronic idiotic scummy " + prose(200 + i, 20), "en", "s0") for i in range(30)]
    item = prose(300, 30)
    odd = [(200, clean[0][1], "en", "s0"), (201, clean[1][1].replace("alpha", "alphaa", 1), "en", "s1"), (202, prose(301, 20) + " " + item + " " + prose(302, 20), "en", "s2"), (203, "mail jo.34@mail7.example.com or 4111111111111111 " + prose(303, 40), "en", "s1"), (204, None, None, None), (205, "", "en", "s1"), (206, prose(304, 60_000), "en", "s2"), (207, "x@" + "a." * 200_000 + "com " + prose(305, 90), "en", None), clean[5]]
    rows = [(*r, len(r[1] or ""), "extra") for r in clean + toxic + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(30)] + [(None, 1, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_pipeline(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    assert not kept & set(range(100, 130)) and kept >= set(range(60)) | {200, 201, 202, 203, 204, 205, 206, 207}
    done = corpus_pipeline.run(spark, folder)
    at = os.path.dirname(done.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(at)) == [os.path.basename(at)]  # what stages before the last one wrote is gone
    out = done.collect()
    assert done.columns == [*corpus_pipeline.COLUMNS, "copy"]
    ids = collections.Counter(r.doc_id for r in out)
    assert not set(ids) & ({200, 202, 204, 205} | set(range(100, 130)))  # copies, leaks and toxic ones; empty texts have no words to take
    assert all(n <= 2 for n in ids.values()) and len(ids) >= 45
    assert all({r.copy for r in out if r.doc_id == i} == set(range(1, n + 1)) for i, n in ids.items())
    hidden = [r.text for r in out if r.doc_id == 203]
    assert all("jo.34@" not in t and "4111111111111111" not in t for t in hidden)
    assert all(r.n_chars == len(r.text) for r in out)


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
