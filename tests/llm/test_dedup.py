import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from legilens.llm import exact_dedup, shared, simhash, substring_dedup, suffix_dedup
from tests.llm import cases


def plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_exact(spark):
    got = exact_dedup.exact_dedup(cases.table(spark))
    assert sorted(map(tuple, got.collect()), key=str) == plain_exact(cases.rows())
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0
    assert exact_dedup.keep_first(cases.table(spark)).columns == cases.table(spark).columns


def test_exact_tells_clashing_digests_apart(spark):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    got = exact_dedup.exact_dedup(cases.table(spark), digest=weak)
    assert sorted(map(tuple, got.collect()), key=str) == plain_exact(cases.rows())


def test_bit_filter(spark):
    keys = spark.range(0, 1000, 7).select(F.col("id").cast("string").alias("k"))
    rows = spark.range(0, 1000).select(F.col("id").cast("string").alias("k"))
    hit = {int(r.k) for r in shared.in_filter(rows, "k", shared.bit_filter(keys, "k", 1 << 20), 1 << 20).collect()}
    assert set(range(0, 1000, 7)) <= hit and len(hit) < 160


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert shared.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    votes = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(shingles))


def plain_components(fps, limit=4):
    values = np.array([fp for _, fp in fps], np.uint64)
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= limit):
            group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(fps):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [(d, f"{fp:016x}", least.get(root(i))) for i, (d, fp) in enumerate(fps)]


def test_simhash(spark):
    docs = cases.rows()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in docs])
    got = simhash.simhash_dedup(cases.table(spark))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert simhash.simhash_dedup(cases.empty(spark)).count() == 0


def test_simhash_links_as_brute_force(spark):
    """Clusters of fingerprints with every distance from 0 to 8, chains included."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)]
    for base in fps[:20]:
        at = base
        for k in range(12):
            for b in rng.choice(64, k % 6 + 1, replace=False):
                at ^= 1 << int(b)
            fps.append(at)
    fps = sorted(set(fps))
    want = {fp: c for fp, (_, _, c) in zip(fps, plain_components([(i, fp) for i, fp in enumerate(fps)]), strict=True)}
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    linked = {r.fp: r.component for r in simhash.link(spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    groups = defaultdict(set)
    for fp, s in zip(fps, signed, strict=True):
        groups[linked[s]].add(fp)
    expected = defaultdict(set)
    for fp in fps:
        expected[want[fp]].add(fp)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def plain_suffix(rows, length):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = []
    for doc_id, raw in raws:
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        out.append((doc_id, len(raw), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix(spark):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = plain_suffix(cases.rows(), 200)
    for hot in (256, 1):  # by merged runs, and by windows
        got = suffix_dedup.suffix_dedup(cases.table(spark), hot=hot).select(*columns)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert suffix_dedup.suffix_dedup(cases.empty(spark)).count() == 0


def test_suffix_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for length, hot in ((200, 256), (64, 3)):
        got = suffix_dedup.suffix_dedup(docs, length=length, hot=hot).drop("spans")
        assert sorted(map(tuple, got.collect()), key=str) == plain_suffix(rows, length)


def test_loser_tree():
    rng = np.random.default_rng(1)
    runs = [sorted(bytes(rng.integers(97, 100, rng.integers(0, 9), dtype=np.uint8)) for _ in range(n)) for n in (0, 5, 40, 1, 17)]
    out = list(suffix_dedup.merged([suffix_dedup.front_coded(r) for r in runs]))
    strings = [s for _, _, s, _ in out]
    assert strings == sorted(s for r in runs for s in r)
    assert [runs[r][i] for r, i, _, _ in out] == strings
    assert all(k == suffix_dedup.common(a, b, 0) for a, b, (_, _, _, k) in zip(strings, strings[1:], out[1:], strict=False))


def test_compact_windows():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 30, 60).astype(np.uint64)
    t = 8
    windows = substring_dedup.compact_windows(y, t)
    for i in range(len(y)):
        for j in range(i + t - 1, len(y)):
            holding = [(a, c, b) for a, c, b in windows if a <= i <= c <= j <= b]
            assert len(holding) == 1 and y[holding[0][1]] == y[i : j + 1].min()


def test_quick_windows():
    rng = np.random.default_rng(3)
    for n in (8, 9, 50, 300):
        y = rng.permutation(n).astype(np.uint64) << np.uint64(30)
        assert sorted(map(tuple, substring_dedup.quick_windows(y, 8).tolist())) == sorted(substring_dedup.compact_windows(y, 8))


def test_substring(spark):
    shared_part = cases.words(60, 50, 10**6)
    edited = shared_part.split()
    edited[30] = "changed"
    made = [(k, cases.words(100, 60 + k, 10**6) + " " + part + " " + cases.words(100, 90 + k, 10**6)) for k, part in enumerate([shared_part, shared_part, " ".join(edited), ""])]
    docs = cases.table(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in made], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(docs).collect() if r.doc_id is not None}
    assert got[100].n_passages == got[101].n_passages == got[102].n_passages == 1 and got[103].n_passages == 0
    assert got[100].class_id == got[101].class_id == got[102].class_id == 100
    low, high = got[100].passages[0]
    assert abs(low - 100) <= 8 and abs(high - 159) <= 8
    assert all(got[k].n_passages for k in (1, 2, 3, 4, 5, 14)) and got[4].class_id == got[5].class_id == 4
    assert not any(got[k].n_passages for k in (6, 7, 8, 9, 12, 13, 15))
    assert substring_dedup.substring_dedup(cases.empty(spark)).count() == 0
    assert substring_dedup.substring_dedup(docs).count() == docs.count()
