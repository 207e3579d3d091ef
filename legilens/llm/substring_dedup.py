"""Near-duplicate passages by compact windows.

The tokens of a text are its shingles of WORDS words. Under one hash function, all subsequences [i, j] of a text whose least
token is the one at c form a compact window (l, c, r): l <= i <= c <= j <= r. Windows are the nodes of the Cartesian tree of the
hash values; only those at least T tokens wide matter, about 2 n / T for n tokens. Subsequences of two windows with the
same least value share that part of their signatures.

Similar passages share RUN tokens in a row somewhere, and with them an anchor, the least token of those. Anchors are counted over all texts; only
around repeated ones (a bit filter of fixed size) windows are made. Windows with one value form a group; each is first paired with a main hub, whose surroundings most
have, and with the group's first and last window. Where the partners of a main hub are not all of one class then, they meet again in finer groups: of tokens that they have and that
hub lacks (finer). There those that are of no class yet are compared with all, if they are few, else all with a main hub; many times more are few at each level, until the members of
each group are of one class or compared (linked).
The pairs of two texts are joined by interval: windows on nearby diagonals that overlap make one candidate passage, if ENOUGH hash functions take
part. Candidates are verified on the tokens: the best matching stretch must have T tokens on both sides and a Jaccard
similarity of SIMILAR or more. Each stretch of a text is cut out once, however many partners it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legilens.llm.shared import bit_filter, components, each_text_once, filter_bytes, in_filter, saved, text_key

#: Words of a shingle, least words of a passage, least similarity.
WORDS, PASSAGE, SIMILAR = 5, 50, 0.8
#: Hash functions, and how many must agree on a pair of passages.
HASHES, ENOUGH = 4, 2
#: Tokens in a row that two similar passages share at least. A place of change costs each side four tokens or more, so e changes leave similarity
#: 0.8 only beside 32 e common tokens, in e + 1 stretches: one of them has 21.
RUN = 20
#: Tokens of a text whose anchors are found at once.
PIECE = 1 << 20
#: Bytes that are hashed at once.
PART = 1 << 16
#: Lower bits of a value that give way to its place.
PLACE = np.uint64((1 << 24) - 1)
#: Bits of the filters of repeated anchors and of repeated values: 8 MB.
BITS = 1 << 26
#: Bits of the filter of texts that have candidates: 2 MB.
TEXT_BITS = 1 << 24
#: Tokens on either side of a shared one that members of a group are told apart by.
AROUND = 45
#: How far apart the diagonals of one passage's windows may be, in tokens: insertions and deletions shift them.
DRIFT = 12
#: Tokens on either side of a shared one, the nearest that a hub lacks, that make finer groups.
NEAR = 16
#: Open members of a finer group that are compared with all others, and how many times more at each further level.
MORE_HUBS = 32

# One odd multiplier for each hash function.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


# The bytes that words are hashed by: A-Z as a-z, blanks as 0, and 0 as a byte that UTF-8 never has; then whether a byte is of a word.
LETTERS = bytes(0 if c in b" \t\n\v\f\r" else 255 if c == 0 else c for c in bytes(range(256)).lower())
OF_WORD = bytes(c not in b" \t\n\v\f\r" for c in range(256))
BLANK = re.compile(rb"[ \t\n\v\f\r]")
#: Powers of an odd number and of its inverse modulo 2^64, more of them as longer texts come.
POWERS = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first powers of base, at least n of them."""
    if len(POWERS.get(base, ())) < n:
        steps = np.full(max(2 * n, 1 << 14), base, np.uint64)
        steps[0] = 1
        POWERS[base] = np.multiply.accumulate(steps)
    return POWERS[base]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte and a hash of each word, in order. The hash is a polynomial of its bytes, from running sums over about PART bytes at once."""
    places, hashes, at, base = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0, int(ODD[2])
    inverse = pow(base, -1, 1 << 64)
    while at < len(text):
        end = at + PART
        end = found.start() if end < len(text) and (found := BLANK.search(text, end)) else len(text)
        part = text[at:end]
        edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + part.translate(OF_WORD) + b"\0", np.int8)))
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(np.frombuffer(part.translate(LETTERS), np.uint8) * powers(len(part), base)[: len(part)], out=sums[1:])
        places.append(first + at)
        hashes.append((sums[last] - sums[first]) * powers(len(part), inverse)[first])
        at = end
    h = np.concatenate(hashes)
    h = (h ^ (h >> np.uint64(32))) * ODD[4]
    return np.concatenate(places), h ^ (h >> np.uint64(29))


def shingles(h: np.ndarray) -> np.ndarray:
    """A hash for each WORDS words in a row."""
    n = max(0, len(h) - WORDS + 1)
    x = np.zeros(n, np.uint64)
    for k in range(WORDS):
        x = (x ^ (x >> np.uint64(29))) * ODD[0] + h[k : k + n] * ODD[1]
    return x ^ (x >> np.uint64(32))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text, in order; letters A-Z count as a-z."""
    return shingles(word_hashes((text or "").encode("utf-8", "replace"))[1])


def tokens_of(column: pa.Array) -> Iterator[np.ndarray]:
    """tokens() of each text; short texts are hashed some at once."""
    some: list[bytes] = []
    held = 0
    for text in column.cast(pa.binary()).to_pylist():
        some.append(text or b"")
        held += len(some[-1]) + 1
        if held >= PART:
            yield from tokens_of_some(some)
            some, held = [], 0
    yield from tokens_of_some(some)


def tokens_of_some(texts: list[bytes]) -> Iterator[np.ndarray]:
    places, h = word_hashes(b"\n".join(texts))
    ends = np.searchsorted(places, np.cumsum([len(t) + 1 for t in texts])).tolist()
    x = shingles(h)
    for low, high in zip([0, *ends], ends, strict=False):
        yield x[low : max(low, high - WORDS + 1)]


def values(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each token: a bijection, so equal values are equal tokens."""
    y = (x ^ (x >> np.uint64(31))) * ODD[k]
    return y ^ (y >> np.uint64(29))


def compact_windows(y: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of the nodes of y's Cartesian tree that are at least least wide; of equal minima the middle one is the root."""
    out, todo = [], [(0, len(y))] if len(y) >= least else []
    while todo:
        low, high = todo.pop()
        part = y[low:high]
        c = int(part.argmin())
        same = np.flatnonzero(part == part[c])
        c = low + int(same[len(same) // 2])
        out.append((low, c, high - 1))
        if c - low >= least:
            todo.append((low, c))
        if high - c > least:
            todo.append((c + 1, high))
    return out


def quick_windows(y: np.ndarray, least: int) -> np.ndarray:
    """compact_windows with the leftmost of equal minima as root. A node is least wide exactly if it is the minimum of some stretch of that width.

    The nearest smaller value on either side of such a node is such a node too, so a stack over these few places finds all ends. Values are compared
    by their upper bits, then by place. Texts that repeat so much that equal minima would make a chain of nodes go to compact_windows.
    """
    n = len(y)
    if n > PLACE:
        return np.array(compact_windows(y, least), np.int32)
    key = (y & ~PLACE) | np.arange(n, dtype=np.uint64)
    width, low = 1, key
    while 2 * width <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < least:
        low = np.minimum(low[: len(low) - (least - width)], low[least - width :])
    # The minima of the stretches come in order of place.
    ranks = low[np.concatenate(([True], low[1:] != low[:-1]))].tolist()
    if len(ranks) > 16 + 8 * n // least:
        return np.array(compact_windows(y, least), np.int32)
    mask = int(PLACE)
    places = [r & mask for r in ranks]
    begin, end, stack = [0] * len(places), [n - 1] * len(places), []
    for k, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            end[stack.pop()] = places[k] - 1
        begin[k] = places[stack[-1]] + 1 if stack else 0
        stack.append(k)
    return np.array((begin, places, end), np.int32).T


def all_windows(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and (k, l, c, r) of all compact windows of a text under all hash functions."""
    keys, rows = [], []
    for k in range(HASHES):
        y = values(x, k)
        w = quick_windows(y, least)
        keys.append(y[w[:, 1]])
        rows.append(np.column_stack((np.full(len(w), k, np.int32), w)))
    return np.concatenate(keys), np.concatenate(rows)


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least token of every stretch of RUN tokens, once for each place: value, and the first and last token of the stretches that it stands for."""
    parts, y = [], values(x, 0)
    for at in range(0, len(y) - RUN + 1, PIECE):
        part = y[at : at + PIECE + RUN - 1]
        low, width = (part & ~PLACE) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * width <= RUN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < RUN:
            low = np.minimum(low[: len(low) - (RUN - width)], low[RUN - width :])
        place = (low & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], len(place)) - 1
        parts.append((part[place[first]], first + at, last + at + RUN - 1))
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of that many rows: bounds what a task holds as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def anchor_counts(texts: DataFrame, least: int) -> DataFrame:
    """(value, n): occurrences of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [anchors(x)[0] for x in tokens_of(b.column(0)) if len(x) >= least]
            if found:
                value, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["value", "n"])

    return texts.select("text").mapInArrow(run, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))


def contexts(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash of the tokens around each place, AROUND on either side or as many as there are: passages that agree there have the same one."""
    base = int(ODD[3])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(31))) * ODD[5] * powers(len(x), base)[: len(x)])))
    low, high = np.maximum(c - AROUND, 0), np.minimum(c + AROUND + 1, len(x))
    h = (sums[high] - sums[low]) * powers(len(x), pow(base, -1, 1 << 64))[low]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def regions(low: np.ndarray, high: np.ndarray, n: int, least: int) -> list[tuple[int, int]]:
    """Half-open stretches of a text of n tokens where a passage may lie: what repeated anchors stand for (inclusive ends, sorted), widened by least
    on both sides. Beyond that there are only common stretches of under RUN tokens, whose similarity is 0.7 at most: a passage may lose such an end."""
    out: list[tuple[int, int]] = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        a, b = max(0, a - least), min(n, b + 1 + least)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= least]


def repeated_windows(texts: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(value, k, row, l, c, r, around) of the compact windows of all regions around repeated anchors."""
    sent = texts.sparkSession.sparkContext.broadcast(filter_bytes(bit_filter(counts, "value", BITS, hashed=True), BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sent.value, np.uint8)
        for b in sliced(batches):
            keys, places, rows, around = [], [], [], []
            for row, x in zip(b.column(0).to_pylist(), tokens_of(b.column(1)), strict=True):
                if len(x) >= least:
                    value, low, high = anchors(x)
                    slot = (value & np.uint64(BITS - 1)).astype(np.int64)
                    hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                    for start, end in regions(low[hit], high[hit], len(x), least):
                        key, place = all_windows(x[start:end], least)
                        place[:, 1:] += start
                        around.append(contexts(x[start:end], place[:, 2] - start))
                        keys.append(key)
                        places.append(place)
                        rows += [row] * len(key)
            if keys:
                place = np.concatenate(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(place[:, 0]), pa.array(rows, pa.binary()), *(pa.array(place[:, i]) for i in (1, 2, 3)), pa.array(np.concatenate(around))],
                    ["value", "k", "row", "l", "c", "r", "around"],
                )

    return texts.select("key", "text").mapInArrow(run, "value bigint, k int, row binary, l int, c int, r int, around bigint")


def main_hubs(members: DataFrame) -> DataFrame:
    """(value, hub, low, high, size): of each group its first and last member, and as hub the first of those members whose surroundings most members have. A text with a change of its own there would
    lack what the others share, and leave all of them to finer groups."""
    place = F.struct("row", "c", "l", "r")
    kinds = members.groupBy("value", "around").agg(F.count("*").alias("n"), F.min(place).alias("hub"), F.max(place).alias("last"))
    best = kinds.groupBy("value").agg(F.min(F.struct((-F.col("n")).alias("less"), "hub")).alias("best"), F.min("hub").alias("low"), F.max("last").alias("high"), F.sum("n").alias("size"))
    return best.select("value", "best.hub", "low", "high", "size")


def hub_pairs(windows: DataFrame) -> DataFrame:
    """Each window with its group's main hub, and with the first and the last one, which are more often the same for all windows of two texts: k, both places, and
    main: whether the hub is the main one of a group in which not all windows are compared so."""
    hubs = F.array_except(F.array_distinct(F.array("hub", "low", "high")), F.array(F.struct("row", "c", "l", "r")))
    each = windows.join(main_hubs(windows).filter("size > 1"), "value").select("k", F.explode(hubs).alias("at"), "hub", "low", "size", "row", "l", "c", "r")
    return placed(each.select("k", F.col("at").alias("hub"), F.expr("size > 3 and (at = hub or at = low)").alias("main"), "row", "l", "c", "r"))


def placed(each: DataFrame) -> DataFrame:
    """Pairs (k, first, l1, c1, r1, second, l, c, r, main) of rows with k, hub, main and the place of a window, but for a window with itself."""
    pairs = each.select(
        "k", F.col("hub.row").alias("first"), F.col("hub.l").alias("l1"), F.col("hub.c").alias("c1"), F.col("hub.r").alias("r1"),
        F.col("row").alias("second"), "l", "c", "r", "main",
    )
    return pairs.filter("first <> second or c1 <> c")


def more_pairs(members: DataFrame, hubs: int, most: DataFrame | None = None) -> DataFrame:
    """The pairs of finer groups (value, n, row, l, c, r): every member with each of so many hubs, all members with each other in groups of no more than that.

    With most (value, hub), members have open too: whether they are to be compared with all others, n is the number of those, and larger groups have that hub only. The rest
    of a group is of one class already, and is compared with those that are open.

    Two members of several such small groups mostly share tokens one after the other: a pair is left out where the token before, as far off in both, is shared in a small group too. That pair
    has the same ends and diagonal and an earlier place, so candidates() makes the same of what is left.
    """
    place, small = F.struct("row", "c", "l", "r"), F.col("n") <= hubs
    if most is None:
        members = members.withColumn("open", F.lit(True))
    along = Window.partitionBy("row", "l", "r", "open", small).orderBy("c", "value")
    before = F.when(small, F.struct(F.lag("value").over(along).alias("value"), (F.col("c") - F.lag("c").over(along)).alias("gap")))
    told = members.select("value", "n", "open", "row", "l", "c", "r", place.alias("place"), F.lit(0).alias("k"), before.alias("before"))
    slot = F.when(small, F.xxhash64("place")).otherwise(F.pmod(F.xxhash64("row"), F.lit(hubs)))
    chosen = (told if most is None else told.filter(small & F.col("open"))).groupBy("value", slot.alias("slot")).agg(F.min(F.struct("place", "before")).alias("first"))
    chosen = chosen.select("value", F.col("first.place").alias("hub"), F.col("first.before").alias("hub_before"))
    if most is not None:
        large = members.filter(~small).select("value").distinct()
        chosen = chosen.unionByName(most.join(large, "value", "left_semi").withColumn("hub_before", F.lit(None)).select("value", "hub", "hub_before"))
    least = chosen.groupBy("value").agg(F.min("hub").alias("least"))
    each = told.join(chosen.join(least, "value"), "value")
    new = "before.value is null or hub_before.value is null or before <> hub_before"
    each = each.filter(F.expr(f"if(n <= {hubs}, (place > hub or not open) and ({new}), place <> hub and place <> least)"))
    return placed(each.select("k", "hub", F.expr(f"n > {hubs} and hub = least").alias("main"), "row", "l", "c", "r"))


def sides(links: DataFrame) -> DataFrame:
    """(row, low, high): both stretches of each link."""
    return links.select(F.col("first").alias("row"), F.col("a").alias("low"), F.col("b").alias("high")).unionByName(
        links.select(F.col("second").alias("row"), F.col("c").alias("low"), F.col("d").alias("high"))
    )


def spans_of(stretches: DataFrame) -> DataFrame:
    """(key, n_links, spans): the verified stretches (row, low, high) of each text, sorted, and how many links they are of."""
    return stretches.groupBy(F.col("row").alias("key")).agg(F.count("*").alias("n_links"), F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))


def classed(classes: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, component): the classes with the links found since; only the few classes that those join are worked on."""
    ends = found.select("first", "second").distinct()
    if classes is None:
        return components(ends, "first", "second")
    named = ends.join(classes.toDF("first", "one"), "first", "left").join(classes.toDF("second", "other"), "second", "left")
    named = saved(named.select("first", "second", F.coalesce("one", "first").alias("la"), F.coalesce("other", "second").alias("lb")), "named")
    nodes = classes.unionByName(named.select(F.col("first").alias("node"), F.col("la").alias("component"))).unionByName(
        named.select(F.col("second").alias("node"), F.col("lb").alias("component"))
    )
    joined = components(named, "la", "lb").toDF("component", "now")
    return saved(nodes.distinct().join(joined, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "classes")


def several(rows: DataFrame, by: str) -> DataFrame:
    """The rows of groups with several rows that are not all of one label; a row without label is of none. With open: whether a row has to be compared with all others, as it
    has no label or there are several; and their number n in the group."""
    groups = rows.groupBy(by).agg(F.count("*").alias("n"), F.count("label").alias("named"), F.min("label").alias("least"), F.max("label").alias("most"))
    groups = groups.filter("n > 1 and (named < n or least <> most)").select(by, F.expr("coalesce(least <> most, false)").alias("mixed"), "n", "named")
    told = rows.join(groups, by).withColumn("open", F.expr("mixed or label is null")).withColumn("n", F.expr("if(mixed, n, n - named)"))
    return told.drop("mixed", "named")


def unsettled(pairs: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of main hubs whose partners are not all of one class, with label: the class of the second text where a verified stretch covers the shared token, else null."""
    open_ = pairs.filter("main and first <> second")
    looked_at = bit_filter(open_, "second", TEXT_BITS)
    spans = spans_of(in_filter(sides(links), "row", looked_at, TEXT_BITS)).select(F.col("key").alias("second"), "spans")
    told = open_.join(spans, "second", "left").join(classes.toDF("second", "component"), "second", "left")
    label = F.when(F.expr("exists(spans, s -> pivot between s.low and s.high)"), F.coalesce("component", "second"))
    told = saved(told.select("first", "a", "b", "second", "c", "d", "pivot", label.alias("label")), "told")
    return several(told, "first").drop("n", "open")


def finer(cuts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(value, row, l, c, r, label): the second texts of the pairs in finer groups by their hub, one for each of the NEAR tokens on either side of the pivot that
    the hub's stretch lacks. Two passages that are similar, one of which has too little in common with the hub, share such tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, places, of, around = [], [], [], []
            for i, (x, y) in enumerate(stretch_pairs(batch)):
                lacking = np.flatnonzero(~np.isin(y, x))
                middle = int(np.searchsorted(lacking, batch.column(6)[i].as_py() - batch.column(4)[i].as_py()))
                near = lacking[max(0, middle - NEAR) : middle + NEAR]
                hub = np.uint64(int.from_bytes(batch.column(0)[i].as_py()[:8], "little"))
                key = (y[near].view(np.uint32).astype(np.uint64) * ODD[0] ^ hub) * ODD[1]
                keys.append(key ^ (key >> np.uint64(31)))
                around.append(contexts(y.view(np.uint32).astype(np.uint64), near))
                places.append(near + batch.column(4)[i].as_py())
                of.append(np.full(len(near), i))
            if keys:
                rows = pa.array(np.concatenate(of))
                second, low, high, label = (batch.column(k).take(rows) for k in (3, 4, 8, 7))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), second, low, pa.array(np.concatenate(places).astype(np.int32)), high, label, pa.array(np.concatenate(around))],
                    ["value", "row", "l", "c", "r", "label", "around"],
                )

    both = side_by_side(cuts, pairs).select("first", "a", "x", "second", "c", "y", "pivot", "label", "d")
    return both.mapInArrow(run, "value bigint, row binary, l int, c int, r int, label binary, around bigint")


def linked(texts: DataFrame, windows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """All links (first, a, b, second, c, d), ends in tokens and inclusive: those with the hubs of groups, then those of finer groups, level by level. And the
    classes (node, component) of the texts with links.

    A group ends when its members are of one class or have all been compared, so there are about as many levels as the logarithm of the largest group's size to the base MORE_HUBS.
    """
    pairs, links, classes, hubs = candidates(hub_pairs(windows), ENOUGH), None, None, MORE_HUBS
    while True:
        pairs = saved(pairs, "pairs")
        cuts = saved(stretches(texts, pairs), "stretches")
        found = saved(verified(cuts, pairs, least), "links")
        links = found if links is None else links.unionByName(found)
        classes = classed(classes, found)
        apart = saved(unsettled(pairs, links, classes), "apart")
        if apart.isEmpty():
            return links.distinct(), classes
        members = saved(several(saved(finer(cuts, apart), "finer"), "value"), "members")
        if members.isEmpty():
            return links.distinct(), classes
        # Members of a finer group have agreed with its hub under ENOUGH hash functions.
        pairs = candidates(more_pairs(members, hubs, main_hubs(members)), 1)
        hubs *= MORE_HUBS


def candidates(pairs: DataFrame, enough: int) -> DataFrame:
    """(first, a, b, second, c, d, pivot, main): tokens a..b of one text and c..d of another (or the same) that may be near-duplicates, with a place in c..d of a
    token that both share. So many hash functions take part."""
    pair = ("first", "second")
    diagonal = Window.partitionBy(*pair).orderBy("diagonal", "c1", "k")
    told = pairs.withColumns({"diagonal": F.col("c1") - F.col("c"), "pivot": F.col("c")})
    told = told.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(diagonal) > DRIFT).cast("int"), F.lit(1)))
    told = told.withColumn("band", F.sum("new").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*pair, "band").orderBy("l1", "r1", "c1", "k")
    reach = F.max("r1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("apart", F.coalesce((F.col("l1") > reach).cast("int"), F.lit(1)))
    told = told.withColumn("part", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = told.groupBy(*pair, "band", "part").agg(
        F.min("l1").alias("a"), F.max("r1").alias("b"), F.min("l").alias("c"), F.max("r").alias("d"), F.size(F.collect_set("k")).alias("agree"),
        F.min("pivot").alias("pivot"), F.bool_or("main").alias("main"),
    )
    return joined.filter(F.col("agree") >= enough).select("first", "a", "b", "second", "c", "d", "pivot", "main")


def similar_stretches(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Inclusive ends in x and y of the matching stretches that are long and similar enough, disjoint in x.

    Two stretches of like length of which a share f is common have similarity f / (2 - f). Tokens gain or lose so that a stretch with exactly
    the least similarity has the sum 0; the longest stretch with a sum of 0 or more is taken, without foreign tokens at its ends, then those on
    either side of it. A stretch that fails against y is cut where its diagonal leaps most, and both parts are looked at again. Where no token of y
    repeats, parts without RUN common tokens in a row are not looked at: they can't be similar enough.
    """
    if len(x) == len(y) >= least and np.array_equal(x, y):
        return [(0, len(x) - 1, 0, len(y) - 1)]
    if len(x) < least or len(y) < least:
        return []
    order = np.argsort(y, kind="stable")
    known = y[order]
    new = np.empty(len(y), bool)
    new[0] = True
    np.not_equal(known[1:], known[:-1], out=new[1:])
    group = np.cumsum(new) - 1  # a number for each different token of y
    theirs_of = np.empty(len(y), np.int64)
    theirs_of[order] = group
    found = np.minimum(np.searchsorted(known, x), len(y) - 1)
    shared = known[found] == x
    n_groups = int(group[-1]) + 1
    if n_groups == len(y) and np.count_nonzero(shared) < SIMILAR * least:
        return []
    ours_of = group[found]
    diagonal = order[found] - np.arange(len(x))  # of a token's places in y the first counts
    ends = np.flatnonzero(~(shared[1:] & shared[:-1] & (diagonal[1:] == diagonal[:-1])))  # last tokens of stretches on one diagonal
    least_run = min(RUN, least) if n_groups == len(y) else 0
    even = 2 * SIMILAR / (1 + SIMILAR)
    gain = np.where(shared, 1 - even, -even)
    out, todo = [], [(0, len(x))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        total = np.concatenate(([0.0], np.cumsum(gain[low:high])))
        lowest = np.minimum.accumulate(total)
        # For each end the first start from which the sum is not negative: lowest falls, so it is found by bisection.
        begin = np.searchsorted(-lowest, -total - 1e-9)
        stop = int(np.argmax(np.arange(len(total)) - begin))
        if stop - int(begin[stop]) < least:  # nor has any part a longer one
            continue
        first = low + int(begin[stop])
        inside = np.flatnonzero(shared[first : low + stop])
        if not len(inside):
            continue
        start, end = first + int(inside[0]), first + int(inside[-1])
        todo += [(low, start), (end + 1, high)]
        if end + 1 - start < least:
            continue
        cuts = ends[np.searchsorted(ends, start) : np.searchsorted(ends, end)]
        if int(np.diff(cuts, prepend=start - 1, append=end).max()) < least_run:
            continue
        width, common = end + 1 - start, shared[start : end + 1]
        own = np.zeros(n_groups, bool)
        own[ours_of[start : end + 1][common]] = True
        places = np.flatnonzero(own[theirs_of])
        c, d = int(places[0]), int(places[-1])
        if d - c + 1 > 1.25 * width:  # matches elsewhere: keep the densest stretch of about the part's width
            ahead = np.searchsorted(places, places + int(1.25 * width))
            k = int(np.argmax(ahead - np.arange(len(places))))
            c, d = int(places[k]), int(places[ahead[k] - 1])
        theirs = np.zeros(n_groups, bool)
        theirs[theirs_of[c : d + 1]] = True
        both, either = np.count_nonzero(own & theirs), np.count_nonzero(own | theirs) + len(np.unique(x[start : end + 1][~common]))
        if d - c + 1 >= least and both >= SIMILAR * either:
            out.append((start, end, c, d))
        else:
            cut = start + weakest(shared[start : end + 1], diagonal[start : end + 1])
            todo += [(start, cut), (cut, end + 1)]
    return out


def weakest(shared: np.ndarray, diagonal: np.ndarray) -> int:
    """Where to cut a stretch, from 1 to its length less 1: before the greatest leap of its common tokens' diagonal, in the middle if there is none. Of equal
    leaps the one nearest to the middle is taken."""
    places = np.flatnonzero(shared)
    leaps = np.abs(np.diff(diagonal[places]))
    if not len(leaps) or not leaps.max():
        return len(shared) // 2
    best = places[1:][leaps == leaps.max()]
    return int(best[np.argmin(np.abs(2 * best - len(shared)))])


def stretches(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, low, high, x): the tokens low..high of each text, as 32 bits each, for every stretch that pairs name, once."""
    wanted = sides(pairs).distinct().groupBy(F.col("row").alias("key")).agg(F.collect_list(F.struct("low", "high")).alias("wanted"))
    wanted = saved(wanted, "wanted")
    some = in_filter(texts, "key", bit_filter(wanted, "key", TEXT_BITS), TEXT_BITS)

    def as_batch(out: tuple[list, ...]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["row", "low", "high", "x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: tuple[list, ...] = ([], [], [], [])
            held = 0
            for key, whole, parts in zip(b.column(0).to_pylist(), tokens_of(b.column(1)), b.column(2).to_pylist(), strict=True):
                x = whole.astype(np.uint32).view(np.int32)
                for p in parts:
                    stretch = x[p["low"] : p["high"] + 1]
                    held += len(stretch)
                    for v, value in zip(out, (key, p["low"], p["high"], stretch), strict=True):
                        v.append(value)
                if held > 1 << 21:
                    yield as_batch(out)
                    out, held = ([], [], [], []), 0
            yield as_batch(out)

    return some.join(wanted, "key").select("key", "text", "wanted").mapInArrow(cut, "row binary, low int, high int, x array<int>")


def side_by_side(cuts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the tokens of both stretches, as x and y."""
    second = cuts.select(F.col("row").alias("second"), F.col("low").alias("c"), F.col("high").alias("d"), F.col("x").alias("y"))
    first = cuts.select(F.col("row").alias("first"), F.col("low").alias("a"), F.col("high").alias("b"), "x")
    # A hub is the first of many pairs, so the rows are dealt out by the second in the end.
    return pairs.join(first, ["first", "a", "b"]).join(second, ["second", "c", "d"])


def stretch_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The tokens of both stretches of each pair: columns 2 and 5."""
    lists = [batch.column(i) for i in (2, 5)]
    flat = [v.flatten().to_numpy(zero_copy_only=False) for v in lists]
    ends = [np.cumsum([0, *v.value_lengths().to_pylist()]) for v in lists]
    for i in range(batch.num_rows):
        yield tuple(f[e[i] : e[i + 1]] for f, e in zip(flat, ends, strict=True))


def verified(cuts: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(first, a, b, second, c, d) of the candidates that hold, ends in tokens and inclusive."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            ids = zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True)
            for (one, low1, other, low2), (x, y) in zip(ids, stretch_pairs(batch), strict=True):
                for got in similar_stretches(x, y, least):
                    out.append((one, low1 + got[0], low1 + got[1], other, low2 + got[2], low2 + got[3]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.binary(), pa.int32(), pa.int32()) * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["first", "a", "b", "second", "c", "d"])

    both = side_by_side(cuts, pairs).select("first", "a", "x", "second", "c", "y")
    return both.mapInArrow(verify, "first binary, a int, b int, second binary, c int, d int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE) -> DataFrame:
    """One row per row of docs: doc_id, n_passages, n_links, class_id, passages.

    passages are maximal stretches of words (first and last, inclusive) that a similar passage elsewhere, in another row or another place of
    the same one, was verified for; n_links counts those verifications; class_id is the smallest doc_id that the row is linked with, directly or
    over others, itself included. Equal texts are one text in the search: copies get the passages of the text, with
    its whole length as a passage where it has enough words, and its class. Null texts count as empty; texts of fewer than passage words have no passages, whatever their copies.
    Other columns are ignored.
    """
    least = passage - WORDS + 1
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text_key(text).alias("key"))
    members = saved(rows.select("doc_id", "key"), "members")
    groups = saved(members.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "groups")
    repeated = groups.filter("copies > 1")
    texts = saved(each_text_once(rows, repeated), "texts")
    counted = in_filter(texts, "key", bit_filter(repeated, "key", TEXT_BITS), TEXT_BITS)
    counted = counted.select("key", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).filter(F.col("words") >= passage)

    counts = saved(anchor_counts(texts, least).filter("n > 1"), "anchors")
    windows = saved(repeated_windows(texts, counts, least), "windows")
    several = windows.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")
    windows = saved(in_filter(windows, "value", bit_filter(several, "value", BITS), BITS), "windows")
    links, classes = linked(texts, windows, least)

    by_row = spans_of(sides(links))
    # Overlapping stretches become one; their ends are then in words instead of shingles.
    step = (
        "aggregate(spans, cast(array() as array<struct<low:int,high:int>>), (k, s) -> if(size(k) > 0 and s.low <= element_at(k, -1).high + 1, "
        "concat(slice(k, 1, size(k) - 1), array(named_struct('low', element_at(k, -1).low, 'high', greatest(element_at(k, -1).high, s.high)))), "
        f"concat(k, array(s))), k -> transform(k, s -> named_struct('low', s.low, 'high', s.high + {WORDS - 1})))"
    )
    found = groups.join(by_row.select("key", "n_links", F.expr(step).alias("spans")), "key", "left").join(counted, "key", "left")
    found = found.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("component", "key"))
    smallest = found.groupBy("class").agg(F.min("least_id").alias("class_id"))
    whole = F.array(F.struct(F.lit(0).alias("low"), (F.col("words") - 1).alias("high")))
    copied = (F.col("copies") > 1) & F.col("words").isNotNull()
    per_text = found.join(smallest, "class").select(
        "key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(copied, whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<low:int,high:int>>)"))).alias("passages"),
        F.when(copied, F.col("copies") - 1).otherwise(0).alias("copies"),
    )
    out = members.select("doc_id", "key").join(per_text, "key")
    return out.select("doc_id", F.size("passages").cast("long").alias("n_passages"), (F.col("n_links") + F.col("copies")).cast("long").alias("n_links"), "class_id", "passages")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
