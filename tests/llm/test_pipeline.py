import corpus_pipeline
from ledgerloom.llm.common import Workspace
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    work, seen = Workspace(spark, "test-pipeline"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = work.save(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == before.columns, name
    before, after = seen["minhash"]
    keep = {i for i, _, _, kept in brute.near([(r.doc_id, r.text) for r in before.collect()], 5) if kept}
    assert {r.doc_id for r in after.collect()} == keep
    before, after = seen["suffix_array"]
    removed = {i: n for i, _, n, _, _ in brute.byte_repeats([(r.doc_id, r.text) for r in before.collect()])}
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert len(texts[r.doc_id].encode()) - len(r.text.encode()) in range(removed[r.doc_id], removed[r.doc_id] + 7)
    before, after = seen["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        assert not (r.doc_id in left and any(t in r.text for t in items))
    before, after = seen["packing"]
    assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in before.collect()}


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    """``run`` gives the last stage's rows; what operators wrote on the way is gone."""
    import os

    from ledgerloom.sources import workspace

    monkeypatch.setattr(workspace, "shared_root", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    assert out.where("piece = 0").count() > 0
    left = [p for p, _, files in os.walk(tmp_path) if any(f.endswith(".parquet") for f in files)]
    assert len(left) == 1 and left[0].endswith("packing")
