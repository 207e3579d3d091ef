"""Patterns as a table that a caller may replace or extend: its form, its checks, and the automaton that finds where anything detectable may begin.

A table of patterns is small; it is read once, checked against a bound, and goes to the tasks with their code. Each prefix is cut into one part more than it may have
errors, so one part is in the text unharmed and near its place. An Aho-Corasick automaton finds the parts of all prefixes, headers and web tokens in one pass over the text in
confusion space, and another keywords and schemes in lower case. Spaces inside runs are left out of what the automata read, as runs are compared without them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legilens.functions import dictionaries as known
from legilens.functions import scalars as f

#: Prefixes of a table at most: about a megabyte beside the code of a task.
MOST = 10_000
SCHEMA = (
    "id string, label string, provider string, prefixes array<string>, body_min int, body_max int, charset string, severity string, tolerance int, min_randomness double, place int"
)

Patterns = tuple[known.Pattern, ...]


def default_table(spark: SparkSession) -> DataFrame:
    """The built-in patterns; place is the order in which they are tried."""
    return spark.createDataFrame([(*p._replace(prefixes=list(p.prefixes)), k) for k, p in enumerate(known.PATTERNS)], SCHEMA)


def faults(p: known.Pattern) -> Iterator[str]:
    """What is wrong with a pattern."""
    if not p.id or p.label is None or p.provider is None:
        yield "needs id, label and provider"
    if not p.prefixes or any(not x or re.search(r"\s", x) for x in p.prefixes):
        yield "needs prefixes, without white space"
    elif p.tolerance is None or not 0 <= p.tolerance < min(map(len, p.prefixes)):
        yield "tolerance must be from 0 to less than its shortest prefix"
    if p.body_min is None or p.body_max is None or not 0 < p.body_min <= p.body_max:
        yield "needs 0 < body_min <= body_max"
    if p.charset not in known.CHARSETS:
        yield f"charset must be one of {', '.join(known.CHARSETS)}"
    if p.severity not in known.SEVERITIES:
        yield f"severity must be one of {', '.join(known.SEVERITIES)}"
    if p.min_randomness is None or not 0 <= p.min_randomness <= 1:
        yield "min_randomness must be from 0 to 1"


def compiled(table: DataFrame | None) -> Patterns:
    """The patterns of a table in the order of place, the built-in ones of none. Tables that are too large, repeat an identifier or have a faulty row are refused."""
    if table is None:
        return known.PATTERNS
    rows = table.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).limit(MOST + 1).collect()
    rows.sort(key=lambda r: (r.place is None, r.place, str(r.id)))
    made = tuple(known.Pattern(*r[:3], tuple(r.prefixes or ()), *r[4:10]) for r in rows)
    if sum(len(p.prefixes) for p in made) > MOST or len(made) > MOST:
        raise ValueError(f"more than {MOST} prefixes")
    if len({p.id for p in made}) < len(made):
        raise ValueError("identifiers of patterns must differ")
    if wrong := [f"pattern {p.id!r}: {fault}" for p in made for fault in faults(p)]:
        raise ValueError("; ".join(wrong))
    return made


def dimension(spark: SparkSession, patterns: Patterns = known.PATTERNS) -> DataFrame:
    """One row for each prefix of each pattern, in the order in which they are tried; number is its place in that order."""
    rows = [
        (k, j, p.id, p.label, p.provider, p.severity, known.SEVERITIES.index(p.severity), prefix, f.confusable_python(prefix), f.confusable_python(prefix[0]),
         len(prefix), p.tolerance, p.body_min, p.body_max, known.CHARSETS[p.charset], p.min_randomness, max(map(len, p.prefixes)))
        for k, p in enumerate(patterns)
        for j, prefix in enumerate(p.prefixes)
    ]
    rows = [(number, *row) for number, row in enumerate(rows)]
    schema = (
        "number int, pattern_ord int, prefix_ord int, pattern_id string, label string, provider string, severity string, severity_rank int, prefix string, folded string,"
        " anchor string, prefix_len int, tolerance int, body_min int, body_max int, charset string, min_randomness double, longest int"
    )
    return spark.createDataFrame(rows, schema)


def planted_table(part: DataFrame, mod: int = 40) -> DataFrame:
    """A table of patterns made of the parts' sizes: one for each remainder of p_partkey, its prefix the remainder and the greatest size in it."""
    at = (F.col("p_partkey") % mod).cast("int").alias("place")
    rows = part.groupBy(at).agg(F.max("p_size").alias("size"))
    name = F.concat(F.lit("zq"), "place", F.lit("x"), "size", F.lit("_"))
    return rows.select(
        F.concat(F.lit("part_"), "place").alias("id"), F.concat(F.lit("Part "), "place").alias("label"), F.lit("Parts").alias("provider"), F.array(name).alias("prefixes"),
        F.lit(20).alias("body_min"), F.lit(64).alias("body_max"), F.lit("base62").alias("charset"), F.element_at(F.array(*map(F.lit, known.SEVERITIES)), F.col("place") % 4 + 1).alias("severity"),
        (F.col("place") % 2).alias("tolerance"), F.lit(0.42).alias("min_randomness"), "place",
    )


# Where something may begin

INSIDE = "[A-Za-z0-9_.:/+=@-]"
TABLE = str.maketrans(*f.classes())


def _lookup(to) -> np.ndarray:
    return np.array([ord(to(chr(c))) for c in range(128)], np.uint32)


IS_INSIDE = np.array([bool(re.match(INSIDE, chr(c))) for c in range(128)] + [False])
CLASS_OF, LOWER_OF = _lookup(lambda c: c.translate(TABLE)), _lookup(str.lower)
#: Longest piece of a part that is looked for; a piece of a part is there when the part is.
PIECE = 6
#: Characters of a body's set that follow each other at least, where the body's length is fixed and 85 % of it belong to the set: a little
#: less than the longest stretch that 15 % of others can't avoid.
STRETCH = {"upper_alnum": 4, "hex": 5}
#: No body that reads as a word is more random than this.
WORD_RANDOMNESS = 0.29


def members(c: str) -> str:
    """Pattern of what one character in confusion space may be in a text."""
    singles = known.CONFUSED.get(c) or "".join(x for x in {c, c.upper()} if x.translate(TABLE) == c)
    pairs = [pair for pair, one in known.MERGED if one == c]
    one = "[" + "".join("\\" + x if not x.isalnum() else x for x in sorted(singles)) + "]"
    return "(?:" + "|".join([one, *pairs]) + ")" if pairs else one


def spaced(parts: list[str]) -> str:
    """The parts with or without one space between them: a run is compared without its spaces."""
    return " ?".join(parts)


def readings(piece: str) -> Iterator[str]:
    """A piece in confusion space, and the same with pairs in place of the letters that they are read as."""
    ways = [dict.fromkeys([c, *(pair.translate(TABLE) for pair, one in known.MERGED if one == c)]) for c in piece]
    yield from dict.fromkeys("".join(way) for way in product(*ways))


def parts_of(prefix: str, tolerance: int) -> Iterator[tuple[str, int, int]]:
    """One part more than there may be errors, each with how far behind the beginning it is at least and at most."""
    folded, n = f.confusable_python(prefix), tolerance + 1
    cuts = [len(folded) * k // n for k in range(n + 1)]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield folded[low:high], max(0, low - tolerance) if tolerance else 0, len(prefix) + tolerance - (high - low) if tolerance else 0


def condition(p: known.Pattern, prefix: str) -> str:
    """What must stand where a candidate begins that the prefix accepts, with the body's stretch where that is known."""
    last = ""
    if p.body_min == p.body_max and p.charset in STRETCH:
        last = f"(?=(?:. ?){{1,{p.body_max + p.tolerance}}}?(?:[{known.CHARSETS[p.charset]}] ?){{{STRETCH[p.charset]}}})"
    tries = []
    for part, least, most in parts_of(prefix, p.tolerance):
        ahead = f"(?:. ?){{{least},{most}}}?" if p.tolerance else ""
        tries.append(ahead + spaced([members(c) for c in part]))
    return f"(?={members(f.confusable_python(prefix[0]))})(?={'|'.join(tries)}){last}"


class Search:
    """Where candidates, headers and keywords may begin in a text."""

    def __init__(self, patterns: Patterns):
        self.conditions: list[re.Pattern[str]] = []
        by_needle: dict[str, list[tuple[int, int, str, int]]] = {}

        def look_for(needle: str, least: int, most: int, first: str, number: int) -> None:
            by_needle.setdefault(needle, []).append((least, most, first, number))

        def ruled(rule: str) -> int:
            self.conditions.append(re.compile(rule))
            return len(self.conditions) - 1

        for p in patterns:
            for prefix in p.prefixes:
                number = ruled(condition(p, prefix))
                for part, least, most in parts_of(prefix, p.tolerance):
                    for needle in readings(part[:PIECE]):
                        look_for(needle, least, most, f.confusable_python(prefix[0]), number)
        #: Conditions before this one are those of the prefixes, by number.
        self.among = len(self.conditions)
        web = "eyJ".translate(TABLE)
        look_for(web, 0, 0, web[0], ruled(spaced(list("eyJ"))))
        self.header = len(self.conditions)
        begin = "-----BEGIN".translate(TABLE)
        look_for(begin, 0, 0, begin[0], self.header)
        self.prefixes = self._built({n: (len(n), tuple(dict.fromkeys(v))) for n, v in by_needle.items()})
        self.words = self._built({w: (len(w), k) for k, w in enumerate((*known.KEYWORDS, *known.SCHEMES))})
        head = min((max(1, len(x) - p.tolerance) for p in patterns for x in p.prefixes), default=1)
        #: Behind the shortest beginning such a candidate has a digit, a special sign or a second capital: otherwise it reads as a word. Holds where no pattern accepts words.
        self.no_word = re.compile(rf"eyJ|.{{{head}}}(?=.*[0-9_+/=.-]|.*[A-Z].*[A-Z])", re.S) if all(p.min_randomness > WORD_RANDOMNESS for p in patterns) else re.compile("")

    @staticmethod
    def _built(values: dict[str, tuple]) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for needle, value in values.items():
            out.add_word(needle, value)
        out.make_automaton()
        return out

    def places(self, text: str) -> tuple[dict[int, list[int]], list[int], list[tuple[int, int]]]:
        """Where candidates may begin, with the numbers of the prefixes that may accept what begins there, where headers may, and the keywords (place, number), each in order."""
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = np.minimum(raw, 128)
        inside = IS_INSIDE[small]
        edge = np.ones(len(raw), bool)
        edge[1:] = ~inside[:-1] | (raw[:-1] == 61) | (raw[:-1] == 58)
        glue = raw == 32
        glue[1:] &= inside[:-1]
        glue[:-1] &= inside[1:]
        glue[:1] = glue[-1:] = False
        at = np.flatnonzero(~glue)
        codes = raw[at]
        plain = codes < 128
        read = lambda table: np.where(plain, table[codes & 127], codes).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        # Needles of schemes and keywords have no capital, those of prefixes are in confusion space.
        folded, edges = read(CLASS_OF), edge[at].tobytes()
        starts: dict[int, list[int]] = {}
        heads, tested = [], set()
        for end, (length, entries) in self.prefixes.iter(folded):
            here = end - length + 1
            for least, most, first, number in entries:
                for s in range(max(0, here - most), here - least + 1):
                    if folded[s] == first:
                        if number == self.header:
                            heads.append(int(at[s]))
                        elif edges[s] and (s, number) not in tested:
                            tested.add((s, number))
                            q = int(at[s])
                            if self.conditions[number].match(text, q):
                                starts.setdefault(q, []).extend([number] * (number < self.among))
        words = []
        for end, (length, number) in self.words.iter(read(LOWER_OF)):
            s = end - length + 1
            q = int(at[s])
            if number >= len(known.KEYWORDS):
                if edges[s]:
                    starts.setdefault(q, [])
            elif int(at[end]) - q == length - 1:
                words.append((q, number))
        return dict(sorted(starts.items())), heads, words


@lru_cache(maxsize=4)
def search_for(patterns: Patterns) -> Search:
    return Search(patterns)
