"""The pipeline's stages, each on its own input, against plain versions; and the query over all of them."""

import hashlib

import brute
import pytest
from pyspark.sql import functions as F
from test_documents import texts

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    rows = [(d, t) for d, t in texts(9, 40) if d is not None]
    junk = [(7000 + k, " ".join(f"W{k}Q{j}!!" for j in range(40 + k))) for k in range(60)]
    docs = [(d, t, "en", f"src{(d or 0) % 3}", None if t is None else len(t)) for d, t in rows + junk]
    spark.createDataFrame(docs, FIELDS).repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(d, 0 if d >= 7000 else 1, 0) for d, _, _, _, _ in docs if d % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    items = [(1, " ".join(rows[20][1].split()[:15])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), items


def test_stages(spark, folder):
    import corpus_pipeline

    top, items = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, top)
        out.write.parquet(f"{top}/out{k}")
        out = spark.read.parquet(f"{top}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        seen[k] = (docs, out)
        docs = out
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    pairs = lambda df: [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    before, after = seen[0]
    assert not [d for d in ids(after) if d >= 7000] and len(ids(after)) >= 0.95 * before.filter("doc_id < 7000 and length(text) > 100").count()
    before, after = seen[1]
    kept = {r[0] for r in brute.near_copies(pairs(before)) if r[3]}
    assert set(ids(after)) == kept and after.filter("length(trim(text)) > 0").count() == after.filter("length(trim(text)) > 0").select("doc_id").distinct().count()
    before, after = seen[2]
    bad = {r[0] for r in brute.contaminated(pairs(before), items) if r[5]}
    assert bad and set(ids(after)) == set(ids(before)) - bad
    before, after = seen[3]
    was = dict(pairs(before))
    for d, t, n in after.select("doc_id", "text", "n_chars").collect():
        assert brute.secrets(t) == [] and (t == was[d] or brute.secrets(was[d])) and (t is None or n == len(t))
    before, after = seen[4]
    text = dict(pairs(before))
    assert ids(after) == ids(before)
    for r in after.collect():
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()


def test_run_gives_the_last_stage(spark, folder):
    import corpus_pipeline

    top, _ = folder
    out = corpus_pipeline.run(spark, top)
    want = spark.read.parquet(f"{top}/out4")
    columns = sorted(want.columns)
    assert sorted(map(repr, out.select(*columns).collect())) == sorted(map(repr, want.select(*columns).collect()))


def test_odd_documents(spark, folder, tmp_path):
    """Clashing columns, nulls, repeated rows and a very long text go through all stages."""
    import corpus_pipeline

    clashes = ["node", "root", "set_key", "signature", "text_key", "blob", "spans", "_id", "_blob", "_spans", "_salt", "_stats", "_y", "score", "n_words", "word", "ids_sha256"]
    long = " ".join(f"w{k % 997}x{k % 1009}" for k in range(60_000))
    rows = [(1, "a plain text of some words that stays", "en"), (1, "a plain text of some words that stays", "en"), (None, None, None), (None, "", "en"), (2, long, None), (3, long + " tail", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(f"own {c}") for c in clashes}).withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    columns = docs.columns
    top, _ = folder
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[1:]):
        out = stage(spark, docs, top)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
            assert all(r[c] == f"own {c}" for r in docs.collect() for c in clashes), name
    out = {(r["doc_id"], r["decoded_sha256"]) for r in docs.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out == {(1, sha(rows[0][1])), (None, sha("")), (2, sha(long))} and docs.count() == 4
    assert corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_stats", F.lit(1)), top).columns == ["doc_id", "text", "lang", "_stats"]


def test_empty_documents(spark, folder):
    import corpus_pipeline

    top, _ = folder
    docs = spark.read.parquet(f"{top}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, top).count() == 0
