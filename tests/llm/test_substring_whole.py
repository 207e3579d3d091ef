"""Passages that lie beside others, and families of variants."""

import random

import numpy as np
from legilens.llm import substring_dedup
from tests.llm import cases


def shingles(*parts):
    return substring_dedup.tokens(" ".join(parts))


def test_passages_side_by_side_in_one_text_only():
    one, two, between = (cases.words(n, seed, 10**6) for n, seed in ((60, 201), (60, 202), (30, 203)))
    x, y = shingles(one, two), shingles(one, between, two)
    assert sorted(substring_dedup.similar_stretches(x, y, 46)) == [(0, 55, 0, 55), (60, 115, 90, 145)]
    assert sorted(substring_dedup.similar_stretches(y, x, 46)) == [(0, 55, 0, 55), (90, 145, 60, 115)]
    # The other way round, and a stretch that fails as a whole and in all its parts.
    assert sorted(substring_dedup.similar_stretches(x, shingles(two, between, one), 46)) == [(0, 55, 90, 145), (60, 115, 0, 55)]
    thin = np.insert(x, np.arange(0, len(x), 3), np.arange(39, dtype=np.uint64))
    assert substring_dedup.similar_stretches(x, thin, 46) == []


def variants(passage, changes, seed):
    words = passage.split()
    for k, at in enumerate(changes):
        words[at] = f"variant{seed}x{k}"
    return " ".join(words)


def test_families_of_variants_and_a_hot_line(spark):
    """Passages as those of a comparison of all pairs, where the hubs hold other variants or only a common line."""
    texts, line = [], cases.words(14, 300, 10**6)
    for f in range(12):
        passage = cases.words(60, 310 + f, 10**6)
        family = [passage] * 12 + [variants(passage, (15, 40), f)] * 2 + [variants(passage, (5, 20, 50), 100 + f)] * 2
        texts += [(f, variant) for variant in family]
    rows = [(k, " ".join((cases.words(70, 1000 + k, 10**6), part, cases.words(70, 3000 + k, 10**6)))) for k, (_, part) in enumerate(texts)]
    rows += [(500 + k, " ".join((cases.words(80, 5000 + k, 10**6), line, cases.words(80, 6000 + k, 10**6)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    missing = [k for k in range(len(texts)) if not any(p.low <= 78 and p.high >= 121 for p in got[k].passages)]
    assert missing == [] and all(got[500 + k].n_passages == 0 for k in range(60))
    same = lambda one, other: got[one].class_id == got[other].class_id
    for at in range(0, len(texts), 16):
        assert same(at + 12, at + 13) and same(at + 14, at + 15) and all(same(at, at + k) for k in range(12))


def plain_passages(texts, least):
    """For each text the tokens that lie in a passage similar to one of another text: all pairs of texts, every token looked at."""
    shingled, out = [substring_dedup.tokens(t) for t in texts], [set() for _ in texts]
    for i, x in enumerate(shingled):
        for j, y in enumerate(shingled):
            if i != j and len(np.intersect1d(x, y)):
                for a, b, _, _ in substring_dedup.similar_stretches(x, y, least):
                    out[i].update(range(a, b + 1))
    return out


def test_recall_against_all_pairs(spark):
    """Of the tokens in similar passages at least nine tenths are found; nothing that is in none."""
    r, texts = random.Random(9), []
    for f in range(25):
        passage = cases.words(r.choice((52, 60, 90, 200)), 7000 + f, 10**6)
        for k in range(4):
            words = passage.split()
            for _ in range(r.randint(0, max(1, len(words) // 50))):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = [f"x{f}x{k}x{at}"] * r.randint(0, 2)
            texts.append(" ".join((cases.words(r.randint(0, 150), 8000 + 4 * f + k, 10**6), *words, cases.words(r.randint(0, 150), 9000 + 4 * f + k, 10**6))))
    want = plain_passages(texts, 46)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [set() for _ in texts]
    for row in substring_dedup.substring_dedup(docs).collect():
        for p in row.passages:
            got[row.doc_id].update(range(p.low, p.high - 3))
    hit, all_ = sum(len(w & g) for w, g in zip(want, got, strict=True)), sum(map(len, want))
    documents = sum(bool(w) for w in want), sum(bool(w and g) for w, g in zip(want, got, strict=True))
    print("recall", hit / all_, documents)
    assert hit >= 0.9 * all_ > 0 and documents[1] >= 0.95 * documents[0]
    assert sum(len(g - w) for w, g in zip(want, got, strict=True)) <= 0.05 * all_
