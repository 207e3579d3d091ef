import hashlib
import re

import pytest
from pyspark.sql import functions as F

from legilens.llm import fill_in_middle as fim
from tests.llm import cases

PLAIN = {"letters": "[A-Za-z]+|[^A-Za-z]", "letters_and_digits": "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]", "words": r"[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]", "lines": r"[^\n]+|\n", "characters": r"(?s)."}
TEXTS = ["", "a", " ", "ab cd", "x1y22z", "\n", "a\r\nb\n\n", "😀", "😀😀a😀", "é́ß a​b", "<P> here", "a <S", "<M>", "1 < P > 2", "a" * 5000, "ab " * 4000, " a\u0085b", "𝒜b𝒜"]


@pytest.mark.parametrize("grammar", fim.GRAMMARS)
def test_units(spark, grammar):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", fim.units(F.col("text"), grammar).alias("u")).collect()
    for r in rows:
        assert r.u == re.findall(PLAIN[grammar], r.text) and "".join(r.u) == r.text


def plain(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(PLAIN["letters"], text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_as_plain(spark):
    rows = [(r[0], r[1]) for r in cases.rows()] + [(100 + 50 * k + j, t) for k, t in enumerate(TEXTS) for j in range(40)] + [(-7, "a < b <S"), (2**62, "x y z")]
    made = spark.createDataFrame([(*r, 1, "f", "u") for r in rows], "doc_id bigint, text string, n int, form string, units string")
    got = fim.fill_in_middle(made).withColumn("back", fim.rebuilt(F.col("output"), F.col("form_"))).collect()
    assert len(got) == len(rows) and {r["form_"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n_"], r["form_"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_empty_table_and_no_python(spark):
    made = fim.fill_in_middle(cases.empty(spark))
    assert made.count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
