"""Terms far from their entity, and in texts without it."""

from legilens.llm import pii
from tests.llm import cases


def test_telling_terms_everywhere(spark):
    far = "mail joe@example.com " + cases.words(30, 1, 20) + " Zorblax"
    made = [(k, far + f" {cases.words(5, 90 + k, 20)}") for k in range(12)] + [(50, "Zorblax was seen and Zorblax left")]
    made += [(100 + k, cases.words(40, k, 20)) for k in range(60)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    clean = {r.doc_id: r.clean for r in pii.sanitised(docs).collect()}
    assert len(clean) == len(made) and not any("Zorblax" in t for t in clean.values())
    assert {r.doc_id: r.n_term for r in pii.report(docs).collect()}[50] == 2
