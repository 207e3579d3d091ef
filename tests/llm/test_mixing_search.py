import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from legilens.llm import mixing, registry, topk
from tests.llm import cases


def test_mix_meets_targets(spark):
    rows = [(k, cases.words(20 + k % 50, k), ("en", "de", "fr")[k % 3 if k % 7 else 0], f"s{k % 4}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = {"source": {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}, "lang": {"en": 0.5, "de": 0.25, "fr": 0.25}}
    got = mixing.mix(docs, targets, budget=0.2, sweeps=12)
    whole = got.agg(F.sum("tokens")).first()[0]
    for margin, shares in targets.items():
        for value, share in shares.items():
            mass = got.filter(F.col(margin) == value).agg(F.sum(F.expr("tokens * probability * weight"))).first()[0]
            assert math.isclose(mass, 0.2 * share * whole, rel_tol=1e-3)
    n, expected = got.agg(F.sum(F.when(F.col("selected"), F.col("tokens")).otherwise(0)), F.sum(F.expr("tokens * probability"))).first()
    assert abs(n - expected) < 0.25 * expected


def test_mix_awkward(spark):
    got = mixing.mix(cases.table(spark))
    assert got.count() == len(cases.rows()) and got.filter("tokens = 0 and selected or probability is null").count() == 0
    assert mixing.mix(cases.empty(spark)).count() == 0
    kept = mixing.keep_selected(cases.table(spark))
    assert kept.columns == cases.table(spark).columns


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(9)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 32), (503, [float("inf")] * 32), (504, []), (None, rows[0][1]), (450, rows[50][1]), rows[0]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0).collect()))
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sorted({(i, tuple(v)) for i, v in sound if i % 50 == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in sound if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(table.filter("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(table.filter("vec_id in (0, 1)").limit(2), F.col("vec_id") == 0).count() == 1


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in registry.SQL.items():
        df = registry.QUERIES[name](spark, sf_dir)
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert set(columns) == set(df.columns)
        at = [columns.index(c) for c in df.columns]
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in result.fetchall()), name
