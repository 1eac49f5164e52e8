"""Each stage of the pipeline against a plain version, on what its predecessor kept."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import brute_components, contaminated, item_windows
from pyspark.sql import functions as F

import corpus_pipeline
from tallyrow.llm import common, packing, quality_classifier, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage keeps of documents with a null text, an empty one and a copy more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 100_000)
    odd = docs.limit(2).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    docs, out = docs.union(more).union(odd.withColumn("doc_id", F.col("doc_id") + 200_000)), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_columns(kept):
    assert len(kept) == len(corpus_pipeline.STAGES) == 5
    for before, after in kept[:-1]:
        assert before.columns == after.columns and after.exceptAll(before).count() == 0
    assert kept[0][1].filter("text IS NULL OR text = ''").count() == 0


def test_near_duplicates(kept):
    before, after = kept[2]
    _, comp = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(set(comp.values()))


def test_contamination(spark, kept):
    before, after = kept[3]
    windows = item_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert ids(after) == sorted(r.doc_id for r in before.collect() if not contaminated(r.text, windows))


def test_packing(kept):
    before, after = kept[4]
    own = tokens.encoder(tokens.default_path())
    want = {r.doc_id: own.encode(r.text) for r in before.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for i, x in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and r.ids_crc32 == tokens.crc(x[at : at + r.length])
            at += r.length
        assert at == len(x)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.concatenate([[0], np.cumsum([r.length for r in own])])[:-1].tolist()
        assert sum(r.length for r in own) <= 4096


def test_run_is_the_stages(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == kept[4][1].columns and got.count() > 0


def test_release_trims_the_driver(spark, monkeypatch):
    assert "rim native heap" in common.trim_driver(spark)
    said, trim = [], common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: said.append(trim(s)))
    common.release(spark)
    assert len(said) == 1 and "rim native heap" in said[0]


def test_classifier_learns_from_a_bounded_sample_of_rows_that_share_ids(spark, monkeypatch):
    docs = spark.range(2000).select((F.col("id") % 4).alias("doc_id"), F.concat_ws(" ", F.lit("a word"), "id").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    learned = []
    monkeypatch.setattr(quality_classifier, "Model", lambda x, y: learned.append((len(x), set(y.tolist()))))
    quality_classifier.fit(docs, labels, F.lit(True), sample=50)
    quality_classifier.fit(docs, labels, F.lit(True), sample=5000)
    assert 50 <= learned[0][0] <= 150 and learned[0][1] == {0.0, 1.0} and learned[1][0] == 2000


def test_stages_and_packing_collect_garbage_on_executors(spark, monkeypatch):
    beans = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = beans()
    common.trim_executors(spark)
    assert beans() > before
    said = []
    monkeypatch.setattr(corpus_pipeline, "trim_executors", said.append)
    monkeypatch.setattr(packing, "trim_executors", said.append)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, empty, SF)
        assert len(said) == k + (k == 5)


def test_counting_ids_drops_the_encoder(spark, monkeypatch):
    class Coded:
        """Runs what is mapped here, as a worker does."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            assert sum(b.num_rows for b in run(iter([]))) == 2
            raise StopIteration

    monkeypatch.setattr(tokens, "_made", {})
    tokens.encoder(tokens.default_path())
    with pytest.raises(StopIteration):
        packing.frequencies(Coded(), tokens.default_path(), tokens.END)
    assert not tokens._made


def test_empty(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert Counter(n for n, _ in corpus_pipeline.STAGES).most_common(1)[0][1] == 1
