import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from legilens.llm import pii, quality, sentencepiece, toxicity
from tests.llm import cases


def plain_viterbi(v, word):
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + v.unknown, best[end - 1][1] + [v.bytes[b] for b in word[end - 1].encode()])]
        options += [(best[s][0] + v.pieces[word[s:end]][0], best[s][1] + [v.pieces[word[s:end]][1]]) for s in range(end) if word[s:end] in v.pieces]
        best[end] = max(options, key=lambda o: o[0])
    return best[-1]


def test_sentencepiece_as_brute_force():
    v = sentencepiece.vocabulary(sentencepiece.MODEL)
    words = sorted({"▁" + w for w in cases.words(300, 7, 10**5).split()} | {"▁über", "▁été😀", "▁▁▁▁▁x", "x", "▁thanking", "▁thank", "▁than"})
    score = {i: s for s, i in v.pieces.values()}
    for word, ids in zip(words, v.encode_sorted(words), strict=True):
        total, want = plain_viterbi(v, word)
        if all(i in score for i in ids) and all(i in score for i in want):
            assert sum(score[i] for i in ids) == pytest.approx(total)
        else:
            assert ids == want


def test_sentencepiece_as_library(tmp_path):
    """The library itself searches the same way once the model is marked as a unigram model."""
    import sentencepiece as library

    raw = open(sentencepiece.MODEL, "rb").read()
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # model_type in the trainer's settings
    (tmp_path / "u.model").write_bytes(raw[:at] + b"\x18\x01" + raw[at + 2 :])
    model = library.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    v = sentencepiece.vocabulary(sentencepiece.MODEL)
    texts = [cases.words(50, 3), "Hello world, this is  a test.\nNew line\tand tab", "Été à la mer", "x"]
    score = {i: s for s, i in v.pieces.values()}
    for text, ids in zip(texts, v.encode(texts), strict=True):
        want = model.encode(text)
        total = lambda x: sum(score.get(int(i), 0.0) for i in x)
        assert ids.tolist() == want or total(ids) == pytest.approx(total(want))


def test_sentencepiece_round_trip(spark):
    got = sentencepiece.tokenised(cases.table(spark)).collect()
    assert len(got) == len(cases.rows()) and all(r.round_trip for r in got)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (6, 7))
    assert sentencepiece.tokenised(cases.empty(spark)).count() == 0


def test_sentencepiece_in_one_pass(spark, monkeypatch):
    """One Python worker a core holds a vocabulary, and what it remembers stays small and changes no result."""
    made = sentencepiece.tokenised(cases.table(spark))
    assert made._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1
    texts = [cases.words(60, k, 10**6) + " ▁ " + "long" * 20 for k in range(8)]
    v = sentencepiece.Vocabulary(sentencepiece.MODEL)
    want = [x.tolist() for x in v.encode(texts)]
    monkeypatch.setattr(sentencepiece, "REMEMBERED", 50)
    small = sentencepiece.Vocabulary(sentencepiece.MODEL)
    assert [small.encode([t])[0].tolist() for t in texts] == want and len(small.known) < 80
    assert not any(len(w) > sentencepiece.SHORT for w in small.known)


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
            sound = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if sound:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = [
    "a@b.co_x@y.com, a@b@c.de x@@y.z @home.org me@host", "1.2.3.4.5.6.7.8 300.1.1.1 1..2.3.4 0001.2.3.255", "4041894974608795 4041-8949-7460-8795 4041 8949  7460 8795 1234567890123",
    "+1 (386) 555-3733 +12 +1.2.3.4.5.6.7.8.9 +1+2+386 555 3733 99", "é😀a@b.cd ü+49 (30) 1234567", "", "@" * 50 + "1" * 500 + "." * 50,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_at_random():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("a1.@-+ _5()")) for _ in range(40))
        assert pii.base_spans(text) == plain_spans(text)


def test_pii(spark):
    telling = "Zorblax Quendory lives here, mail joe@example.com for the meeting"
    made = [(k, telling if k < 3 else cases.words(40, k, 50) + f" u{k}@example.com") for k in range(12)]
    docs = cases.table(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in made], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    assert len(got) == len({r[0] for r in cases.rows()}) + 12 and pii.report(docs).count() == docs.count()
    spans = got[100].spans.split(",")
    assert "email:34:49" in spans and "term:0:7" in spans and got[100].n_email == 1
    assert got[6].spans == "" and got[6].n_term == 0
    clean = {r.doc_id: r.clean for r in pii.sanitised(docs.filter("doc_id >= 100")).collect()}
    assert "joe" not in clean[100] and "Zorblax" not in clean[100] and "[email]" in clean[100]
    assert pii.report(cases.empty(spark)).count() == 0


def test_toxicity(spark):
    bad, fine = ["idiot", "moron", "scum"], cases.words(400, 1, 60).split()
    made = []
    for k in range(400):
        text = fine[k % 40 : k % 40 + 30]
        if k % 5 == 0:
            text = [*text, bad[k % 3], bad[(k + 1) % 3]]
        made.append((k, " ".join(text)))
    docs = spark.createDataFrame([*made, (1000, "such a m0r0n"), (1001, "you i d i o t"), (1002, "scuuuum here"), (1003, "room 101 at 5pm"), (1004, None), (1005, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for k, r in got.items() if k < 400 and r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert got[1000].predicted == got[1001].predicted == got[1002].predicted == 1
    assert got[1003].predicted == got[1004].predicted == got[1005].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_awkward(spark):
    for labels in (cases.labels(spark), cases.labels(spark, False)):
        got = toxicity.toxicity(cases.table(spark), labels)
        assert got.count() == len(cases.rows()) and got.filter("score is null or held_out is null").count() == 0
    assert toxicity.toxicity(cases.empty(spark), cases.labels(spark, False)).count() == 0
    assert toxicity.keep_clean(cases.table(spark), cases.labels(spark, False)).columns == cases.table(spark).columns


def test_quality(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has some sixty labels
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out")
    right, n = got.select(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert right >= 0.9 * n


def test_quality_awkward(spark):
    for labels in (cases.labels(spark), cases.labels(spark, False)):
        got = quality.quality(cases.table(spark), labels)
        assert got.count() == len(cases.rows()) and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.quality(cases.empty(spark), cases.labels(spark, False)).count() == 0
