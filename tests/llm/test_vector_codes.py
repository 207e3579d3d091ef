import math
import random

import numpy as np

from legilens.llm import vector_codes as codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, v int"


def plain(rows, parts=8, entries=16, rounds=6):
    """The same in plain integers."""
    kept = [(i, [math.floor(4096 * x) for x in np.array(v, np.float32).astype(float).tolist()], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(cut(v, p), p)[1], []).append(cut(v, p))
            new.append([tuple(sum(c) // len(of[k]) for c in zip(*of[k], strict=True)) if k in of else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), p) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=str), books


def run(spark, rows):
    made = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    coded, books = codes.compressed(made)
    return sorted(map(tuple, coded.collect()), key=str), books, coded


def test_as_plain(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(k % 5, 0.3) for _ in range(16)], k % 3 if k % 4 else None) for k in range(200)]
    rows += [rows[0], (0, [0.5] * 16, 1), (None, [1.0] * 16, None), (300, None, 1), (301, [None] * 16, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] + [0.0] * 15, 1), (304, [], 2), (305, [0.25] * 3, 2)]
    got, books, coded = run(spark, rows)
    want, plain_books = plain(rows)
    assert got == want and [[tuple(e) for e in b] for b in books.tolist()] == plain_books
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    told = codes.with_label_error(coded).collect()
    assert len(told) == len(want) and all(t.label_error == sums[t.label] for t in told)


def test_few_and_awkward_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [], None)], [(1, [0.1] * 8, 1)], [(2, [0.1] * 9, 1), (1, [-0.1] * 9, 1)], [(k, [1.0] * 8, 0) for k in range(40)]):
        got, books, _ = run(spark, rows)
        want, plain_books = plain(rows)
        assert got == want and [[tuple(e) for e in b] for b in books.tolist()] == plain_books


def test_large_components(spark):
    (row,), _, _ = run(spark, [(1, [1e30] * 8, 1)])
    assert row[3] == 0
    got, _, _ = run(spark, [(k, [1e30 * (-1) ** k] * 8, 1) for k in range(20)])
    assert all(g[3] == 0 for g in got)
