"""Suffix-array deduplication: bytes of passages of LENGTH bytes that occur again anywhere in the corpus are removed.

Every window of LENGTH bytes has an anchor: of the GRAM-byte strings inside it the one with the least hash, the leftmost if
there are several. Equal windows have equal anchors at equal offsets, so only windows whose anchor's string occurs again can
repeat. Those anchors' suffixes are sorted, in a distributed merge sort:

1. each task sorts the suffixes it finds into runs and front-codes them (length of the prefix shared with the one before, and the rest);
2. the runs are exchanged in blocks by a hash of the anchor's string, so that all that can match meets;
3. a loser tree merges the runs of a block. It knows how long a prefix each contender shares with the last suffix that left the tree; a
   longer one wins unseen, and equal ones are compared from there on, so known prefixes are never compared again. The
   merged order comes with its common-prefix lengths.

Within a group of suffixes of one anchor string, forward common prefixes (from the merge) and backward common suffixes say
which windows of two anchors are equal. Anchor strings with more than HOT occurrences go another exact way, as windows
themselves: a task combines equal windows first, so a string that a third of all documents holds sends one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import bit_filter, each_text_once, filter_bytes, flagged, repeated_texts, saved, text_key

LENGTH, GRAM = 200, 32
#: Occurrences of an anchor string above which its windows are grouped instead of merged: bounds a group to some 6 MB and a few seconds.
HOT = 20_000
#: Bits of the filters of repeated and of hot anchor strings (8 MB each, whatever the input).
BITS = 1 << 26
#: Bits of the filter of texts that lose something: 2 MB.
HIT_BITS = 1 << 24
#: Suffixes in a block of the exchange, about, and in a run of one task.
BLOCK, RUN = 10_000, 200_000
#: Windows combined at once by a task.
COMBINE = 1 << 20
#: Bytes of a text hashed at once.
PIECE = 1 << 19

# Odd multipliers for hashing.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)
POSITION = np.uint64(PIECE * 2 - 1)


def words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number."""
    return np.ndarray((len(raw) - 7,), "<u8", buffer=raw.data, strides=(1,))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[4]
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that begin at each place."""
    w, n = words_at(raw), len(raw) - GRAM + 1
    x = w[:n] * ODD[0]
    for k in range(1, GRAM // 8):
        x += w[8 * k : 8 * k + n] * ODD[k]
    return mixed(x)


def anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor's place, its hash, first and last window start."""
    n = len(raw) - length + 1
    parts = []
    for low in range(0, n, PIECE):
        piece = raw[low : min(low + PIECE, n) + length - 1]
        h = gram_hashes(piece)
        # Hash above, place below: the least is the least hash's leftmost place.
        key = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
        width, least = 1, key
        span = length - GRAM + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        parts.append((at[first] + low, h[at[first]], first + low, last + low))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter has each hash."""
    slot = (h & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def window_hashes(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows at starts; length is a multiple of 8 or the last word overlaps."""
    w = words_at(raw)
    a, b = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in [*range(0, length - 7, 8), length - 8]:
        x = w[starts + k]
        a = (a ^ mixed(x * ODD[0])) * ODD[1]
        b = (b + mixed(x * ODD[2] + ODD[3])) * ODD[0]
    return a, b


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that share the first at bytes."""
    most = min(len(a), len(b))
    while at < most and a[at : at + 16] == b[at : at + 16]:
        at += 16
    if at >= most:
        return most
    while at < most and a[at] == b[at]:
        at += 1
    return at


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Prefix lengths shared with the string before, and the rests."""
    shared, rests, before = [], [], b""
    for s in strings:
        k = common(before, s, 0)
        shared.append(k)
        rests.append(s[k:])
        before = s
    return shared, rests


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, string, prefix shared with the string before) of front-coded sorted runs, in order."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    known = [0] * k  # prefix shared with the last string that left the tree
    place = [-1] * k

    def step(r: int) -> None:
        place[r] += 1
        if r < len(runs) and place[r] < len(runs[r][0]):
            shared = runs[r][0][place[r]]
            heads[r] = (heads[r] or b"")[:shared] + runs[r][1][place[r]]
            known[r] = shared
        else:
            heads[r] = None

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows the prefix it shares with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        at = common(a, b, known[x])
        if at == len(a) or (at < len(b) and a[at] < b[at]):
            known[y] = at
            return x, y
        known[x] = at
        return y, x

    for r in range(k):
        step(r)
    losers = [0] * k
    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        pairs = [play(level[2 * i], level[2 * i + 1]) for i in range(len(level) // 2)]
        for i, (_, loser) in enumerate(pairs):
            losers[node + i] = loser
        level = [winner for winner, _ in pairs]
    top = level[0]
    while (head := heads[top]) is not None:
        yield top, place[top], head, known[top]
        step(top)
        node = (k + top) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


Entry = tuple[bytes, int, int, int, bytes, bytes, int]


def repeated(group: list[Entry], length: int) -> Iterator[tuple[bytes, int, int]]:
    """(row, low, high): bytes covered by windows that repeat within a group of (row, place, least j, greatest j, forward, backward, shared).

    Window j of an anchor begins j bytes before it. Two anchors' windows j are equal when both have that window, their forward
    strings share length - j bytes and their backward strings j. shared is the forward prefix shared with the entry before.
    """
    same: dict[tuple[bytes, bytes, int], list[int]] = {}
    for i, e in enumerate(group):
        same.setdefault((e[4], e[5], e[2]), []).append(i)
    classes = list(same.values())
    for members in classes:
        if len(members) > 1:
            for i in members:
                row, at, low, high = group[i][:4]
                yield row, at - high, at - low + length
    if len(classes) < 2:
        return
    first = [m[0] for m in classes]
    order = sorted(range(len(first)), key=lambda c: group[first[c]][5])
    back = [0, *(common(group[first[x]][5], group[first[y]][5], 0) for x, y in zip(order, order[1:], strict=False))]
    n = len(first)
    # Forward prefix shared with the class before: the least over the entries between.
    ahead = np.array([0, *(min(group[i][6] for i in range(first[c - 1] + 1, first[c] + 1)) for c in range(1, n))])
    behind, back = np.append(ahead[1:], 0), np.array(back)
    rank, place = np.array(order), np.empty(n, np.int64)
    place[rank] = np.arange(n)
    low = np.array([group[i][2] for i in first])
    high = np.array([group[i][3] for i in first])
    for c, members in enumerate(classes):
        if len(members) > 1:
            continue
        # Shared with each other class: least common prefixes on the way to it, in forward and in backward order.
        f, b = np.empty(n, np.int64), np.empty(n, np.int64)
        f[c + 1 :] = np.minimum.accumulate(ahead[c + 1 :])
        f[:c] = np.minimum.accumulate(behind[:c][::-1])[::-1]
        k = place[c]
        b[rank[k + 1 :]] = np.minimum.accumulate(back[k + 1 :])
        b[rank[:k]] = np.minimum.accumulate(back[k:0:-1])[::-1]
        f[c] = b[c] = 0
        lo = np.maximum(np.maximum(low, low[c]), length - f)
        hi = np.minimum(np.minimum(high, high[c]), b)
        hit = lo <= hi
        hit[c] = False
        if hit.any():
            pairs = np.unique(np.column_stack((lo[hit], hi[hit])), axis=0)
            row, at = group[members[0]][:2]
            for j_low, j_high in joined([tuple(p) for p in pairs.tolist()]):
                yield row, at - j_high, at - j_low + length


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of whole numbers, with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


COUNTS = "gram bigint, n bigint"
FOUND = (
    "kind int, row binary, low int, high int, w1 bigint, w2 bigint, bucket int, rows array<binary>, places array<int>, "
    "least array<int>, most array<int>, shared array<int>, rests array<binary>, backs array<binary>"
)
SPANS = "row binary, low int, high int"


def raw_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def anchor_counts(texts: DataFrame, length: int) -> DataFrame:
    """(gram, n): occurrences of each anchor string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(raw, length)[1] for x in b.column(0).to_pylist() if len(raw := raw_of(x)) >= length]
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    return texts.select("text").mapInArrow(run, COUNTS).groupBy("gram").agg(F.sum("n").alias("n"))


def search(texts: DataFrame, counts: DataFrame, length: int, hot: int) -> DataFrame:
    """Rows of three kinds: 0 bytes known to repeat, 1 a window of a hot string, 2 a front-coded block of a sorted run."""
    sc = texts.sparkSession.sparkContext
    twice = counts.filter("n > 1")
    size = twice.filter(f"n <= {hot}").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-size // BLOCK))
    sent = sc.broadcast([filter_bytes(bit_filter(x, "gram", BITS, hashed=True), BITS) for x in (twice, twice.filter(f"n > {hot}"))])
    empty = {f.name: None for f in pa_schema(FOUND)}

    def batch(kind: int, n: int, **columns) -> pa.RecordBatch:
        values = empty | columns | {"kind": [kind] * n}
        return pa.RecordBatch.from_arrays([pa.array(values[f.name] if values[f.name] is not None else [None] * n, f.type) for f in pa_schema(FOUND)], schema=pa_schema(FOUND))

    def windows(held: list, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Equal windows of one task: those that repeat are known at once; one of each goes on to meet other tasks'."""
        if not held:
            return
        w1, w2, row, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, row, w2, w1))
        w1, w2, row, at = w1[order], w2[order], row[order], at[order]
        new = np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(new)))
        many = np.repeat(count > 1, count)
        if many.any():
            r, s = row[many], at[many]
            o = np.lexsort((s, r))
            r, s = r[o], s[o]
            cut = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1))))
            end = np.append(cut[1:], len(r)) - 1
            yield batch(0, len(cut), row=[names[i] for i in r[cut].tolist()], low=s[cut].astype(np.int32), high=(s[end] + length).astype(np.int32))
        yield batch(1, len(first), w1=w1[first].view(np.int64), w2=w2[first].view(np.int64), row=[names[i] for i in row[first].tolist()], low=at[first].astype(np.int32), high=np.minimum(count, 2).astype(np.int32))

    def blocks(held: list) -> Iterator[pa.RecordBatch]:
        """One sorted run of suffixes, cut by bucket and front-coded."""
        held.sort(key=lambda e: (e[0], e[5]))
        at = 0
        while at < len(held):
            end = at
            while end < len(held) and held[end][0] == held[at][0]:
                end += 1
            part = held[at:end]
            shared, rests = front_coded([e[5] for e in part])
            columns = {name: [[e[i] for e in part]] for i, name in ((1, "rows"), (2, "places"), (3, "least"), (4, "most"), (6, "backs"))}
            yield batch(2, 1, bucket=[part[0][0]], shared=[shared], rests=[rests], **columns)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, often = (np.frombuffer(x, np.uint8) for x in sent.value)
        hot_held, hot_n, names, cold = [], 0, [], []
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = raw_of(text)
                if len(raw) < length:
                    continue
                at, gram, first, last = anchors(raw, length)
                maybe = has(some, gram)
                if not maybe.any():
                    continue
                at, gram, first, last = at[maybe], gram[maybe], first[maybe], last[maybe]
                many = has(often, gram)
                if many.any():
                    n = last[many] - first[many] + 1
                    starts = np.repeat(first[many] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    hot_held.append((*window_hashes(raw, starts, length), np.full(len(starts), len(names)), starts))
                    names.append(row)
                    hot_n += len(starts)
                few, whole = ~many, raw.tobytes()
                bucket = (gram[few] >> np.uint64(20)) % np.uint64(buckets)
                for k, a, s, t in zip(bucket.tolist(), at[few].tolist(), first[few].tolist(), last[few].tolist(), strict=True):
                    cold.append((k, row, a, a - t, a - s, whole[a : t + length], whole[s:a][::-1]))
                if hot_n > COMBINE:
                    yield from windows(hot_held, names)
                    hot_held, hot_n, names = [], 0, []
                if len(cold) > RUN:
                    yield from blocks(cold)
                    cold = []
        yield from windows(hot_held, names)
        yield from blocks(cold)

    return texts.select("key", "text").mapInArrow(run, FOUND)


def pa_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = []
    for f in ddl.split(", "):
        name, kind = f.split(" ")
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(fields)


def merge_blocks(found: DataFrame, length: int) -> DataFrame:
    """(row, low, high): bytes that repeat, from the merged order of every bucket's runs."""
    names = ("rows", "places", "least", "most", "shared", "rests", "backs")

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        rows, places, least, most, shared, rests, backs = (table.column(n).to_pylist() for n in names)
        out: list[tuple[bytes, int, int]] = []
        group: list[Entry] = []
        for r, i, string, known in merged(list(zip(shared, rests, strict=True))):
            if known < GRAM:
                if len(group) > 1:
                    out.extend(repeated(group, length))
                group = []
            group.append((rows[r][i], places[r][i], least[r][i], most[r][i], string, backs[r][i], known))
        if len(group) > 1:
            out.extend(repeated(group, length))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, pa_schema(SPANS), strict=True)], schema=pa_schema(SPANS))

    return found.filter("kind = 2").select("bucket", *names).groupBy("bucket").applyInArrow(merge, SPANS)


def hot_windows(found: DataFrame, length: int) -> DataFrame:
    """(row, low, high) of the windows that two tasks or more hold, one window of each task."""
    met = found.filter("kind = 1").groupBy("w1", "w2").agg(F.sum("high").alias("n"), F.collect_list(F.struct("row", "low")).alias("at"))
    each = met.filter("n > 1").select(F.explode("at").alias("at")).select("at.row", "at.low")
    return each.select("row", "low", (F.col("low") + length).alias("high"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of low and high bytes removed).

    Equal texts are one text in the search; a text of length bytes or more that two rows have goes as a whole.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in any row, the same one included. Null texts
    count as empty; texts shorter than length keep everything; repeated rows lose what they share with each other. length must be
    at least 40. Other columns of docs are ignored.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text_key(text).alias("key"))
    copies = saved(repeated_texts(rows), "copies")
    texts = each_text_once(rows.filter(F.octet_length("text") >= length), copies)
    counts = saved(anchor_counts(texts, length).filter("n > 1"), "counts")
    found = saved(search(texts, counts, length, hot), "found")
    spans = found.filter("kind = 0").select("row", "low", "high").unionByName(hot_windows(found, length)).unionByName(merge_blocks(found, length))
    by_text = spans.groupBy(F.col("row").alias("key")).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    # A text that two rows have goes as a whole; both lists have a row for each different text.
    hits = saved(by_text.join(copies, "key", "full").select("key", "spans", F.col("copies").isNotNull().alias("whole")), "hits")
    told = flagged(rows, "key", bit_filter(hits, "key", HIT_BITS), HIT_BITS, "maybe")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, spans, whole in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw = text.encode("utf-8", "replace")
                gone = [(0, len(raw))] if whole and len(raw) >= length else contiguous(sorted((s["low"], s["high"]) for s in spans or ()))
                kept, at = hashlib.sha256(), 0
                for low, high in gone:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                for x, v in zip(out, (len(raw), sum(h - s for s, h in gone), len(gone), kept.hexdigest(), [{"low": s, "high": h} for s, h in gone]), strict=True):
                    x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<low:int,high:int>>"
    some = told.filter("maybe").join(hits, "key", "left").select("doc_id", "text", "spans", "whole").mapInArrow(cut, schema)
    none = told.filter("not maybe").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
        F.expr("cast(array() as array<struct<low:int,high:int>>)").alias("spans"),
    )
    return some.unionByName(none)


def contiguous(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open sorted spans with touching and overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
