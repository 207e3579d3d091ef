"""run() against the stages' brute-force versions, one after the other."""

import corpus_pipeline
import duckdb
from legilens.llm import mixing, sentencepiece, toxicity
from tests.llm.test_dedup import plain_components, plain_exact, plain_fingerprint


def test_run(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect() if r.doc_id not in toxic]
    kept = {r[0] for r in plain_exact(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    kept = {d for d, _, c in plain_components([(r[0], plain_fingerprint(r[1])) for r in rows]) if d == c}
    left = docs.filter(docs.doc_id.isin(kept))
    left.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    selected = {r[0] for r in con.execute(f"select doc_id from ({mixing.SQL}) where selected").fetchall()}
    v = sentencepiece.vocabulary(sentencepiece.MODEL)
    want = {r[0]: v.encode([r[1] or ""])[0].tolist() for r in rows if r[0] in selected}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and got


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
