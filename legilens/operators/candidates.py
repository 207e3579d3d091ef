"""Candidates for secrets: tokens, what follows = or : in them, and runs of fragments that were torn apart by single spaces.

Places are code points of the text, found in one pass over each Arrow batch. Detection doesn't look at every candidate: an automaton made of a table of patterns
(see patterns) says where one may begin that some detector accepts, and only candidates at such places are made.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legilens.functions import dictionaries as known
from legilens.functions import scalars as f
from legilens.operators.patterns import INSIDE, IS_INSIDE, Patterns, Search, search_for

#: Least length of a suffix, and the most fragments of a run.
SUFFIX, SPAN = 12, 6
#: No pattern, connection string or web token accepts fewer characters.
SHORTEST = 12
TOKEN = re.compile(f"[^{known.WHITE}{re.escape(known.BETWEEN)}]+")
GAP = re.compile(f"[{known.WHITE}{re.escape(known.BETWEEN)}]")
#: Two or more fragments with exactly one space between neighbours, as many as there are.
CHAIN = re.compile(f"(?<!{INSIDE}){INSIDE}++(?: {INSIDE}++)+")
ENDS = ".:,-"

#: Level (0 token, 1 run), start and end of what it was taken from, offset in it: the order in which candidates are tried.
Order = tuple[int, int, int, int]
Candidate = tuple[Order, int, int, str]
#: The detector that looks at it first, the number of the keyword before it, the numbers of the prefixes that may accept it, and the candidate.
Item = tuple[int, int | None, list[int] | None, Candidate]


def tokens(text: str) -> Iterator[Candidate]:
    """Tokens without the signs in ENDS at their end."""
    for m in TOKEN.finditer(text):
        if t := m.group().rstrip(ENDS):
            end = m.start() + len(t)
            yield (0, m.start(), end, 0), m.start(), end, t


def suffixes(candidate: Candidate) -> Iterator[Candidate]:
    """What follows each = and :, unless it is short or padding only. Inside a run places are approximate but stay within it."""
    (level, low, high, _), start, end, t = candidate
    for m in re.finditer("[=:]", t):
        rest = t[m.end() :]
        if len(rest) >= SUFFIX and rest.strip("="):
            yield (level, low, high, m.end()), min(start + m.end(), end), end, rest


def glued(text: str) -> Iterator[Candidate]:
    """Runs of 2 to SPAN neighbours of a chain, without the spaces between them."""
    for m in CHAIN.finditer(text):
        parts, begins = _parts(m)
        for a, low in enumerate(begins):
            for b in range(a + 2, min(a + SPAN, len(parts)) + 1):
                high = begins[b - 1] + len(parts[b - 1])
                yield (1, low, high, 0), low, high, "".join(parts[a:b])


def _parts(chain: re.Match[str]) -> tuple[list[str], list[int]]:
    """The fragments of a chain and where they begin."""
    parts = chain.group().split(" ")
    return parts, [chain.start() + n for n in accumulate((len(p) + 1 for p in parts[:-1]), initial=0)]


def every(text: str) -> Iterator[Candidate]:
    for made in (tokens(text), glued(text)):
        for c in made:
            yield c
            yield from suffixes(c)


# Candidates that some detector may accept


def likely(text: str, search: Search) -> Iterator[Candidate]:
    """Those of every() that some detector may accept."""
    return (c for _, c in likely_at(text, search, search.places(text)[0]))


def likely_at(text: str, search: Search, starts: dict[int, list[int]]) -> Iterator[tuple[list[int], Candidate]]:
    """The same from the places where they may begin, each behind the numbers of the prefixes that may accept it."""
    if starts:
        for q, c in _made(text, list(starts)):
            if len(c[3]) >= SHORTEST and search.no_word.match(c[3]):
                yield starts[q], c


def _made(text: str, at: list[int]) -> Iterator[tuple[int, Candidate]]:
    """The candidates that begin at the given places, each behind its place."""
    for q in at:
        told = q > 0 and text[q - 1] in "=:"
        if told or not q or GAP.match(text, q - 1):
            if (m := TOKEN.match(text, q)) and (t := m.group().rstrip(ENDS)) and not (told and (len(t) < SUFFIX or not t.strip("="))):
                yield q, ((0, q, q + len(t), 0), q, q + len(t), t)
    for m in CHAIN.finditer(text):
        k = bisect_left(at, m.start())
        if k == len(at):
            break
        parts, begins = [], []
        while k < len(at) and at[k] < m.end():
            if not parts:
                parts, begins = _parts(m)
                lengths = [0, *accumulate(map(len, parts))]
            yield from ((at[k], c) for c in _runs(parts, begins, lengths, at[k]))
            k += 1


def _runs(parts: list[str], begins: list[int], lengths: list[int], q: int) -> Iterator[Candidate]:
    """The runs of a chain, and their suffixes, whose first character is at q. The suffix of a run may begin in each of its fragments."""
    i = bisect_left(begins, q + 1) - 1
    inside, n = q - begins[i], len(parts)
    told = parts[i][inside - 1] in "=:" if inside else i > 0 and parts[i - 1][-1] in "=:"
    for a in range(max(0, i - SPAN + 1) if told else i, i + 1):
        if a == i and inside and not told:
            continue
        offset = lengths[i] - lengths[a] + inside
        for b in range(max(i + 1, a + 2), min(a + SPAN, n) + 1):
            rest, low, high = "".join(parts[a:b])[offset:], begins[a], begins[b - 1] + len(parts[b - 1])
            if not offset or (len(rest) >= SUFFIX and rest.strip("=")):
                yield (1, low, high, offset), min(low + offset, high), high, rest


# Other beginnings


def _header(text: str) -> str:
    """Pattern of a header in confusion space, which keeps lengths."""
    table = str.maketrans(*f.classes())
    return "".join("[" + "".join("\\" + x if not x.isalnum() else x for x in sorted(known.CONFUSED.get(c.translate(table)) or {c.lower(), c.upper()})) + "]" for c in text)


HEADERS = [re.compile(_header(h)) for h in known.PEM_HEADERS]


def headers(text: str, at: list[int]) -> Iterator[Candidate]:
    """Headers of private keys at the given places; overlapping ones count."""
    for q in at:
        for k, h in enumerate(HEADERS):
            if found := h.match(text, q):
                yield (k, q, found.end(), 0), q, found.end(), found.group()


def assignments(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, Candidate]]:
    """Of the keywords (place, number) the first of each number in each line: the number, and what follows it there. The order is that of the line."""
    start, end, met = 0, -1, set()
    for q, number in sorted(words):
        if q > end:
            start, end = text.rfind("\n", 0, q) + 1, text.find("\n", q)
            end, met = len(text) if end < 0 else end, set()
        if number not in met:
            met.add(number)
            after = q + len(known.KEYWORDS[number])
            yield number, ((0, start, end, 0), after, end, text[after:end])


def detectable(text: str, search: Search) -> Iterator[Item]:
    """What some detector may accept, by the detector that looks at it first: 0 header of a private key, 1 candidate, 3 what follows a keyword."""
    starts, heads, words = search.places(text)
    yield from ((0, None, None, c) for c in headers(text, heads))
    yield from ((1, None, numbers, c) for numbers, c in likely_at(text, search, starts))
    yield from ((3, number, None, c) for number, c in assignments(text, words))


def reported(text: str, search: Search) -> Iterator[Item]:
    """The same with every candidate that is long enough."""
    _, heads, words = search.places(text)
    yield from ((0, None, None, c) for c in headers(text, heads))
    yield from ((1, None, None, c) for c in every(text) if len(c[3]) >= SHORTEST)
    yield from ((3, number, None, c) for number, c in assignments(text, words))


KINDS = {
    "tokens": lambda text, search: ((0, None, None, c) for c in tokens(text)),
    "suffixes": lambda text, search: ((0, None, None, s) for c in tokens(text) for s in suffixes(c)),
    "glued": lambda text, search: ((0, None, None, c) for c in glued(text)),
    "all": lambda text, search: ((0, None, None, c) for c in every(text)),
    "detectable": detectable,
    "reported": reported,
}
ITEM = "kind int, word int, tries array<int>, level int, low int, high int, offset int, start int, end int, token string"
#: Items and characters of a batch that is handed on.
BATCH, CHARACTERS = 50_000, 1 << 24


def explode(rows: DataFrame, kind: str = "detectable", patterns: Patterns = known.PATTERNS) -> DataFrame:
    """(id, seq, kind, word, start, end, token) of the candidates of each (id, text); seq is their order, word the number of the keyword before them. Null texts have none.

    The detectable ones also have tries, the numbers of the prefixes that may accept them.
    """
    made = KINDS[kind]
    texts = rows.select("id", "text").filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 2 + [pa.list_(pa.int32())] + [pa.int32()] * 6 + [pa.string()]
        names = ["id", *(part.split(" ")[0] for part in ITEM.split(", "))]
        search = search_for(patterns)

        def batch(owners: pa.Array, ids: list[int], found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([owners.take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

        for b in batches:
            ids, found, held = [], [], 0
            for i, text in enumerate(b.column(1).to_pylist()):
                for k, word, numbers, (order, start, end, token) in made(text, search):
                    ids.append(i)
                    found.append((k, word, numbers, *order, start, end, token))
                    held += len(token)
                    if len(found) >= BATCH or held > CHARACTERS:
                        yield batch(b.column(0), ids, found)
                        ids, found, held = [], [], 0
            yield batch(b.column(0), ids, found)

    items = texts.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {ITEM}")
    return items.select("id", F.struct("level", "low", "high", "offset").alias("seq"), "kind", "word", *["tries"] * (kind == "detectable"), "start", "end", "token")


# Sizes of candidates that aren't made

#: No gap between tokens has a greater code point.
LAST_GAP = 0x3000
IS_GAP = np.array([bool(GAP.match(chr(c))) for c in range(LAST_GAP + 1)] + [False])
IS_ENDS = np.array([chr(c) in ENDS for c in range(128)] + [False])
#: Characters that are looked at together, about; longer texts are cut at the ends of lines, which no candidate crosses.
TOGETHER = 1 << 20


def _before(values: np.ndarray) -> np.ndarray:
    """Sums of what stands before each place, and of all."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def _stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and end."""
    turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return turns[::2], turns[1::2]


def spans(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, length) of every candidate, as arrays: what every() gives, in another order and without the characters."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_only, place = np.minimum(raw, 128), np.arange(len(raw))
    signs, solid = np.flatnonzero((raw == 61) | (raw == 58)), _before(raw != 61)

    start, end = _stretches(~IS_GAP[np.minimum(raw, LAST_GAP + 1)])
    end = np.maximum.accumulate(np.where(IS_ENDS[ascii_only], -1, place))[end - 1] + 1
    start, end = start[end > start], end[end > start]
    yield start, end, end - start
    of = np.searchsorted(start, signs, "right") - 1
    told = signs[of >= 0] + 1
    high = end[of[of >= 0]]
    good = (high - told >= SUFFIX) & (solid[np.maximum(high, told)] > solid[told])
    yield told[good], high[good], (high - told)[good]

    inside = IS_INSIDE[ascii_only]
    low, high = _stretches(inside)
    if not len(low):
        return
    sums, solid = _before(high - low), _before(inside & (raw != 61))
    glue = (low[1:] - high[:-1] == 1) & (raw[high[:-1]] == 32)
    chain = _before(~glue)
    of = np.searchsorted(low, signs, "right") - 1
    at = sums[of] + signs + 1 - low[of]  # behind the sign, without spaces
    for n in range(2, min(SPAN, len(low)) + 1):
        a = np.flatnonzero(chain[: len(low) - n + 1] == chain[n - 1 :])
        yield low[a], high[a + n - 1], sums[a + n] - sums[a]
        for back in range(n):
            a = of - back
            k = np.flatnonzero((a >= 0) & (a + n <= len(low)))
            k = k[chain[a[k]] == chain[a[k] + n - 1]]
            a, p = a[k], at[k]
            last, length = high[a + n - 1], sums[a + n] - p
            good = (length >= SUFFIX) & (solid[last] > solid[signs[k] + 1])
            yield np.minimum(low[a] + p - sums[a], last)[good], last[good], length[good]


def counted(texts: list[str | None], together: int = TOGETHER) -> np.ndarray:
    """A column for each text: the number of its candidates, their characters, and the sums of their starts and ends."""
    out = np.zeros((4, len(texts)), np.int64)
    pieces: list[str] = []
    owners: list[int] = []
    offsets: list[int] = []
    held = 0

    def add() -> None:
        begins = _before([len(p) + 1 for p in pieces])
        owner, offset = np.array(owners), np.array(offsets)
        for start, end, length in spans("\n".join(pieces)):
            k = np.searchsorted(begins, start, "right") - 1
            moved = offset[k] - begins[k]
            for row, value in zip(out, (1, length, start + moved, end + moved), strict=True):
                np.add.at(row, owner[k], value)

    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            cut = text.find("\n", at + together)
            cut = len(text) if cut < 0 else cut
            pieces.append(text[at:cut])
            owners.append(i)
            offsets.append(at)
            held += cut - at
            at = cut + 1
            if held >= together:
                add()
                pieces, owners, offsets, held = [], [], [], 0
    if pieces:
        add()
    return out


def sizes(rows: DataFrame) -> DataFrame:
    """(id, n, chars, starts, ends) of each (id, text) that has candidates: their number, their characters, and the sums of their starts and ends, from their places alone."""
    names = ["n", "chars", "starts", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counted(b.column(1).to_pylist()))], ["id", *names])

    each = rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names))
    return each.filter("n > 0")
