"""Large groups: many families of variants that have a common line, against all pairs with a verification of its own."""

import random

import pytest
from pyspark.sql import functions as F

from legilens.llm import substring_dedup
from tests.llm import cases


def family_texts(families, each, line, passage, changed):
    """(family, text): passages that hold one line common to all, between words of their own. The members of a family differ in so many words."""
    common, out = cases.words(line, 1, 10**6), []
    for f in range(families):
        own = cases.words(passage - line, 100 + f, 10**6).split()
        for k in range(each):
            words = common.split() + own
            for i in range(changed):
                words[-1 - 6 * i] = f"v{f}x{k}x{i}"
            out.append((f, " ".join((cases.words(60, 5000 + 97 * f + k, 10**6), *words, cases.words(60, 90000 + 97 * f + k, 10**6)))))
    return out


def shingle_list(text):
    w = text.lower().split()
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def similar(x, y):
    """Whether the stretches between the first and the last shingle that two texts of one family share hold together: long and similar enough."""
    shared = set(x) & set(y)
    if not shared:
        return False
    ends = [[i for i, s in enumerate(t) if s in shared] for t in (x, y)]
    a, b = x[ends[0][0] : ends[0][-1] + 1], y[ends[1][0] : ends[1][-1] + 1]
    return min(len(a), len(b)) >= 46 and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))


@pytest.mark.parametrize("families, each, line, passage, changed", [(60, 2, 42, 56, 0), (40, 4, 40, 70, 1), (150, 2, 36, 60, 1)])
def test_families_with_a_common_line(spark, families, each, line, passage, changed):
    made = family_texts(families, each, line, passage, changed)
    x = [shingle_list(t) for _, t in made]
    wanted = [(i, j) for i in range(len(x)) for j in range(i) if similar(x[i], x[j])]
    assert wanted and all(made[i][0] == made[j][0] for i, j in wanted)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(made)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect()}
    met = [(i, j) for i, j in wanted if got[i].class_id == got[j].class_id and got[i].passages and got[j].passages]
    print("recall", len(met), len(wanted))
    assert len(met) >= 0.95 * len(wanted)
    assert all(made[k][0] == made[got[k].class_id][0] for k in got)  # no family is linked with another


@pytest.mark.parametrize("hubs", [8, 64])
def test_pairs_of_finer_groups_are_made_once_for_tokens_in_a_row(spark, hubs):
    """Members that share many tokens one after the other, some moved, some apart: a few pairs for each two, and the candidates of all pairs."""
    members = []
    for i in range(24):
        row, shift = i.to_bytes(2, "big"), 3 * (i % 4)
        for t in range(32):
            at = 40 + shift + t + (50 if t >= 20 and i % 3 == 0 else 0)
            if t != i % 7 or i % 2:
                members.append((t if t % 11 else 1000 + 100 * t + i % 5, bytearray(row), 10 + shift, at, 200 + shift))
    of = {}
    for m in members:
        of.setdefault(m[0], []).append(m)
    table = spark.createDataFrame([(v, len(x), *m[1:]) for v, x in of.items() for m in x if len(x) > 1], "value bigint, n bigint, row binary, l int, c int, r int")
    got = substring_dedup.more_pairs(table, hubs)
    ends = ("first", "a", "b", "second", "c", "d", "pivot", "main")
    every = [(0, bytes(x[1]), *x[2:5], bytes(y[1]), *y[2:5], False) for v in of.values() if len(v) <= hubs for x in v for y in v if (bytes(x[1]), x[3], x[2], x[4]) < (bytes(y[1]), y[3], y[2], y[4])]
    plain = spark.createDataFrame(every, "k int, first binary, l1 int, c1 int, r1 int, second binary, l int, c int, r int, main boolean")
    shown = lambda df: sorted(tuple(map(str, r)) for r in df.select(*ends).collect())
    if hubs < 24:
        plain = plain.unionByName(got)
    assert shown(substring_dedup.candidates(got, 1)) == shown(substring_dedup.candidates(plain.distinct(), 1))
    assert hubs < 24 or got.count() < len(every) / 4


def test_many_variants_of_one_passage_take_few_pairs(spark, monkeypatch):
    """Members that each have changes of their own: the hub of a group is one without a change there, so that few are left to finer groups."""
    base, r, n, rows = cases.words(150, 7, 10**6).split(), random.Random(3), 240, []
    for k in range(n):
        words = base[:]
        for at in r.sample(range(150), 3):
            words[at] = f"v{k}x{at}"
        rows.append((k, " ".join(words)))
    made, real = [], substring_dedup.more_pairs

    def counted(*args):
        made.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(substring_dedup, "more_pairs", counted)
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    print("pairs of finer groups", made)
    assert all(x.class_id == 0 and x.passages for x in got) and len(got) == n
    assert sum(made) <= 20 * n


def test_open_members_meet_all_others(spark):
    """In a group of one class but for some, those are compared with each other and with the rest; the rest is not compared again."""
    rows = [(1, bytes([k]), 0, 50, 100, b"x" if k > 2 else None, k % 2) for k in range(40)]
    members = substring_dedup.several(spark.createDataFrame(rows, "value bigint, row binary, l int, c int, r int, label binary, around int"), "value")
    got = substring_dedup.more_pairs(members, 4, substring_dedup.main_hubs(members)).select("first", "second", "main").collect()
    met = {frozenset((bytes(x.first)[0], bytes(x.second)[0])) for x in got}
    assert met == {frozenset((a, b)) for a in range(3) for b in range(40) if a != b} and len(got) == len(met) and not any(x.main for x in got)
    # More open ones than hubs: all with the main hub, the first of those whose surroundings most have.
    got = substring_dedup.more_pairs(members, 2, substring_dedup.main_hubs(members)).select("first", "second", "main").collect()
    assert len(got) == 39 and {bytes(x.first) for x in got} == {b"\0"} and all(x.main for x in got)
