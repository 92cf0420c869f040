"""The pipeline's stages on a small corpus, each against what it should keep."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from guardloom.llm import quality, shingles, toxicity  # noqa: E402
from guardloom.llm.common import materialise  # noqa: E402

SF = "/root/testdata/sf0.001"


def first_of_each(docs):
    """Smallest doc_id of each class of texts that a similarity of 0.8 of five-word shingles joins."""
    rows = sorted((r["doc_id"], shingles.shingles(r["text"])) for r in docs.select("doc_id", "text").collect())
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if shared >= 0.8 * (len(a) + len(b) - shared):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {top(i) for i in root}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "simhash near-dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "stage")
        ids = {r[0] for r in docs.select("doc_id").collect()}
        kept = [r[0] for r in out.select("doc_id").collect()]
        assert set(kept) <= ids
        if name == "quality":
            scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
            assert sorted(kept) == sorted(r[0] for r in scored.where("keep").select("doc_id").collect())
        elif name == "toxicity":
            scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
            assert sorted(kept) == sorted(r[0] for r in scored.where("predicted = 0").select("doc_id").collect())
        elif name == "simhash near-dedup":
            assert set(kept) == first_of_each(docs)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    again = corpus_pipeline.run(spark, SF)
    assert again.count() == docs.count()


ODD = [(None, None, None, None, None, 1), (1, "", "en", "web", 0, 2), (1, "", "en", "web", 0, 2), (2, "some words of a text " * 30, None, None, 630, 3), (3, "x " * 200_000, "en", "web", 400_000, 4), (None, "some other words", "en", "book", 16, 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 int"


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, rows):
    """Nulls, empty and long texts, repeated rows, a clashing name, an empty table: no stage
    fails, all but the last keep the columns, and no row comes from nowhere."""
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "odd")
        if name == "packing":
            assert (out.count() > 0) == bool(rows)
            continue
        assert out.dtypes == docs.dtypes
        kept = out.select("doc_id", "k1").distinct().collect()
        assert set(kept) <= set(docs.select("doc_id", "k1").distinct().collect())
        if name == "simhash near-dedup":
            assert out.count() == (len(rows) and 4)
