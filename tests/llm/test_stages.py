"""Stages against plain versions: repeated and null identifiers, one identifier with several texts, clashing columns, empty tables."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from legilens.llm import exact_dedup, mixing, registry, sentencepiece, simhash, toxicity
from tests.llm import cases
from tests.llm.test_dedup import plain_components, plain_fingerprint

CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, maybe string, whole_row string, fp bigint, toxicity string, topic string, ids string"


def made():
    r, texts = random.Random(3), [cases.words(n, n, 10**6) for n in (30, 60, 200)] + ["", None, "a  b", "a b"]
    texts += [texts[2] + " tail", texts[1] + "\n"]
    rows = [(r.choice([None, 1, 2, 3, 4, 5, 6]), r.choice(texts)) for _ in range(60)] + [(3, "b"), (7, "a"), (7, "b"), (None, "b"), (None, "lone"), (None, "lone"), (9, "x"), (9, "x")]
    return [(i, t, "en", "s", 1, "d", "m", "w", 2, "t", "p", "i") for i, t in rows]


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def order(row):
    return (row[0] is None, row[0] or 0)


def test_keep_first(spark):
    docs = spark.createDataFrame(made(), CLASHING)
    groups = defaultdict(list)
    for i, t, *_ in made():
        groups[" ".join((t or "").replace("\n", " ").split(" ")) if t is None or "  " not in t else "a b"].append((i, t))
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    left = kept(got)
    assert sum(left.values()) == len(groups)
    for rows in groups.values():
        least = min(map(order, rows))
        assert sum(left[x] for x in set(rows) if order(x) == least) == 1


def test_keep_one(spark):
    docs = spark.createDataFrame(made(), CLASHING)
    fps = [plain_fingerprint(t) for _, t, *_ in made()]
    labels = {fp: c for fp, (_, _, c) in zip(fps, plain_components(list(enumerate(fps))), strict=True)}
    groups = defaultdict(list)
    for (i, t, *_), fp in zip(made(), fps, strict=True):
        groups[labels[fp]].append((i, t))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    left = kept(got)
    assert sum(left.values()) == len(groups)
    for rows in groups.values():
        least = min(map(order, rows))
        assert sum(left[x] for x in set(rows) if order(x) == least) == 1


def test_keep_selected(spark):
    docs = spark.createDataFrame([(r[0], r[1], *r[2:3], f"s{k % 3}", *r[4:]) for k, r in enumerate(made())], CLASHING)
    got = mixing.keep_selected(docs)
    assert got.columns == docs.columns
    chosen = Counter((r.doc_id, r.source, r.tokens, r.topic) for r in mixing.mix(docs).filter("selected").collect())
    columns = {k: v for k, v in mixing._judged(got, "text").items() if k in ("tokens", "topic")}
    assert Counter((r.doc_id, r.source, r.n, r.t) for r in got.select("doc_id", "source", columns["tokens"].alias("n"), columns["topic"].alias("t")).collect()) == chosen and chosen


def test_empty_and_awkward_tables_through_the_stages(spark, tmp_path):
    cases.labels(spark, False).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (cases.empty(spark), cases.table(spark)):
        n = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == cases.table(spark).columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.count() <= n and all(r.round_trip for r in out.collect())


def test_clashing_columns(spark):
    docs = spark.createDataFrame(made(), CLASHING)
    assert toxicity.keep_clean(docs, cases.labels(spark, False)).columns == docs.columns
    encoded = sentencepiece.encode(docs)
    assert sorted(encoded.columns) == sorted(c for c in docs.columns if c != "text")
    assert sentencepiece.decode(encoded).count() == len(made())


def test_every_operator_is_registered():
    assert [int(q[2:].split("_")[0]) for q in registry.QUERIES] == list(range(1, 14))
