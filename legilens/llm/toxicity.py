"""Toxicity: restore obfuscated words with a noisy-channel decoder, then score the restored text.

Three small models, each of a fixed size, are learnt from the data:

* a trigram model of characters over all texts of the corpus (no labels), LETTERS ** 3 counts;
* a lexicon of words and word beginnings that mark toxic texts, from labelled rows whose crc32(doc_id) mod 5 is not 0. At most
  TRAIN_ROWS of those rows are used, taken in the order of a hash of their identifier;
* the odds of a text without any such term.

The channel writes letters as look-alike digits and signs, repeats them and puts separators between them. A token that
shows such marks becomes a lattice: each observed sign offers its possible letters, a run offers one or two of its letter,
separators offer nothing. Viterbi search under the trigram model finds the most likely words behind it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import free, saved

#: Labelled rows used for the lexicon, in the order of a hash of their identifier: the bound of what is learnt from labels.
TRAIN_ROWS = 20_000
#: Least documents for a term, and least evidence (twice the log-likelihood ratio) beside twice the logarithm of the terms tested.
SUPPORT, EVIDENCE = 5, 8.0
#: Least share of toxic texts among those with the term, as the lower end of a 95 % interval: a term alone must make toxicity likelier than not.
SHARE = 0.5
#: The same for a term that texts explained by other terms have: sixteen toxic texts without a clean one.
CERTAIN = 0.8
#: Lengths of the word beginnings that are terms beside the word itself.
STARTS = (4, 5, 6)
#: Character classes: 0 boundary, a-z 1-26, Latin-1 small letters from U+00DF 27-59, 60 any other letter, 61 other signs' boundary.
LETTERS = 64
#: Restorations kept for a token, and how far behind the best one may be (natural log).
BEST, MARGIN = 4, 5.0

# Signs that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou", "€": "e", "£": "l",
}
#: Costs (negative log probabilities) of the channel's steps.
AS_WRITTEN, LOOKS_ALIKE, DOUBLED = 0.0, 0.7, 0.7

WORD = re.compile(r"[^\W\d_]+")
MARKED = re.compile(r"[0-9@$!|+(*#€£]")
TOKEN = re.compile(r"[^\s.,;:?\"'<>=/\\{}\[\]]+")
#: A sign that is not a digit beside another look-alike.
SIGNS = re.compile(r"[@$€£][0-9@$!|+(*#€£]|[0-9@$!|+(*#€£][@$€£]")
REPEATED = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+*#])(?:[ ._*-](?:[^\W_]|[@$!|+*#])){2,}(?![^\s.,;:?!])")


def classes() -> np.ndarray:
    """Character class by code point, for code points below 65536."""
    out = np.zeros(65536, np.int64)
    for c in range(65536):
        if chr(c).isalpha():
            out[c] = 60
    out[97:123] = np.arange(1, 27)
    out[0xDF:0x100] = np.arange(27, 60)
    out[0xF7] = 0
    return out


def class_of(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if "\xdf" <= c <= "\xff" and c != "\xf7":
        return ord(c) - 0xDF + 27
    return 60 if c.isalpha() else 0


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each triple of character classes occurs in all texts; at most LETTERS ** 3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = classes(), np.zeros(LETTERS**3, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
                    c = table[np.minimum(codes, 65535)]
                    grams = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
                    if len(grams) > LETTERS**2:
                        total += np.bincount(grams, minlength=LETTERS**3)
                    else:
                        np.add.at(total, grams, 1)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["gram", "n"])

    counts = docs.select(text_col).mapInArrow(run, "gram bigint, n bigint")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of the third of three character classes, interpolated with the pair's and single's."""
    tri = np.zeros(LETTERS**3)
    for row in character_counts(docs, text_col).collect():  # at most LETTERS ** 3 rows
        tri[row["gram"]] = row["n"]
    tri = tri.reshape(LETTERS, LETTERS, LETTERS)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    single = (uni + 1) / (uni.sum() + LETTERS)
    pair = (bi + 5 * single) / (bi.sum(axis=1, keepdims=True) + 5)
    return np.log((tri + 5 * pair) / (tri.sum(axis=2, keepdims=True) + 5))


def terms_of(text: str) -> set[str]:
    """The words of a text and their beginnings, the latter with a trailing *."""
    words = set(WORD.findall(text.lower()))
    return words.union(w[:k] + "*" for k in STARTS for w in words if len(w) > k)


def surely(k: int, n: int, z: float = 1.96) -> float:
    """Lower end of Wilson's interval for a share of k in n."""
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def lexicon(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[dict[str, float], float, float]:
    """Terms with their log odds, the prior log odds, and those of a text without terms.

    Evidence is counted over different texts, so that a text with many copies speaks once; the prior is the toxic share of all rows used.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    told = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = told.join(F.broadcast(known), "doc_id").groupBy("text", (F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n"))  # TRAIN_ROWS labels at most
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "train")
    sums = {r["toxic"]: (r["texts"], r["n"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()}
    (n0, all0), (n1, all1) = sums.get(0, (0, 0)), sums.get(1, (0, 0))
    base = (all1 + 0.5) / (all0 + all1 + 1)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, terms = [], []
            for i, text in enumerate(b.column(0).to_pylist()):
                found = terms_of(text)
                owners += [i] * len(found)
                terms += found
            at = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(terms, pa.string())], ["row", "toxic", "term"])

    pairs = saved(rows.select("text", "row", "toxic").mapInArrow(named, "row bigint, toxic int, term string"), "pairs")
    counts = pairs.groupBy("term").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).filter(F.col("t") >= SUPPORT)
    counts = saved(counts, "terms")
    least = EVIDENCE + 2 * math.log(max(1, counts.count()))
    strong = {r["term"]: (r["c"], r["t"]) for r in counts.filter(f"t / (c + t) >= {SHARE}").collect()}  # terms of TRAIN_ROWS texts at most

    def gain(c: float, t: float) -> float:
        p = t / (c + t)
        return 2 * (t * math.log(p / base) + (c * math.log((1 - p) / (1 - base)) if c else 0)) if p > base else 0.0

    likely = {name: (c, t) for name, (c, t) in strong.items() if surely(t, c + t) >= SHARE and gain(c, t) >= least}
    where: dict[str, list[tuple[int, int]]] = {name: [] for name in likely}
    table = docs.sparkSession.createDataFrame([(name,) for name in likely], "term string")
    for r in pairs.join(F.broadcast(table), "term").collect() if likely else ():  # the places of the terms above
        where[r["term"]].append((r["row"], r["toxic"]))
    inside: dict[int, list[str]] = {}
    for name, places in where.items():
        for row, _ in places:
            inside.setdefault(row, []).append(name)
    left = {name: [c, t] for name, (c, t) in likely.items()}
    chosen = {name for name, (c, t) in likely.items() if surely(t, t + c) >= CERTAIN}  # hardly any clean text has them
    explained: set[int] = set()
    # Greedy choice: the term with the most evidence among the texts that no chosen term explains. Words that only come along with toxic ones drop out.
    while True:
        name, best = max(((name, gain(c, t)) for name, (c, t) in left.items() if t and surely(t, t + c) >= SHARE), key=lambda x: (x[1], x[0]), default=("", 0.0))
        if best < least:
            break
        chosen.add(name)
        for row, toxic in where[name]:
            if row not in explained:
                explained.add(row)
                for other in inside[row]:
                    left[other][toxic] -= 1
        left.pop(name)
    odds = {name: math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1)) for name, (c, t) in likely.items() if name in chosen}
    prior = math.log(base / (1 - base))
    return odds, prior, min(prior - 3.0, -3.0)


class Decoder:
    """Most likely words behind an obfuscated token, by Viterbi search over its lattice."""

    def __init__(self, model: np.ndarray):
        self.model = model.astype(np.float64)
        self.cache: dict[str, list[str]] = {}

    def restore(self, token: str) -> list[str]:
        if token not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = self.decode(token)
        return self.cache[token]

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal signs, the letters it may stand for and what the channel asks for each."""
        signs = [c for c in token if c not in " ._-"]
        columns, at = [], 0
        while at < len(signs):
            end = at
            while end < len(signs) and signs[end] == signs[at]:
                end += 1
            c, run = signs[at], end - at
            letters = [(c, AS_WRITTEN)] if c.isalpha() else [(x, LOOKS_ALIKE) for x in LOOKALIKES.get(c, "")]
            if letters:
                columns.append([(x, w) for x, w in letters] + ([(x + x, w + (DOUBLED if run > 2 else 0)) for x, w in letters] if run > 1 else []))
            at = end
        return columns

    def decode(self, token: str) -> list[str]:
        m = self.model
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
        for column in self.lattice(token):
            after: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), paths in states.items():
                for letters, cost in column:
                    x, y, gain = a, b, -cost
                    for c in letters:
                        k = class_of(c)
                        gain += m[x, y, k]
                        x, y = y, k
                    after.setdefault((x, y), []).extend((score + gain, word + letters) for score, word in paths)
            states = {s: sorted(p, reverse=True)[:BEST] for s, p in after.items()}
        ends = sorted(((score + m[a, b, 0], word) for (a, b), p in states.items() for score, word in p), reverse=True)
        return [word for score, word in ends[:BEST] if word and score >= ends[0][0] - MARGIN]


def suspicious(text: str) -> set[str]:
    """Tokens that show the channel's marks, however long: look-alikes beside letters or alone, runs of a letter, letters spaced out."""
    found = set()
    if MARKED.search(text):
        for t in TOKEN.findall(text):
            core = t.strip("!|()*#+-_")
            if MARKED.search(core) and any(map(str.isalpha, core)):
                found.add(core)
            elif SIGNS.search(t) and not any(map(str.isalpha, t)):  # look-alikes alone, not a mere number
                found.add(t)
    if REPEATED.search(text):
        found.update(t for t in TOKEN.findall(text) if REPEATED.search(t))
    found.update(m.group() for m in SPACED.finditer(text))
    return found


class Scorer:
    """Toxicity of a text, from 0 to 1."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], prior: float, none: float):
        self.decoder, self.weights, self.prior, self.none = Decoder(model), weights, prior, none
        self.heads = {t[:4] for t in weights}
        self.longest = max(map(len, weights), default=0)

    def terms(self, words: set[str]) -> set[str]:
        w, out = self.weights, set()
        for x in words:
            if x[:4] in self.heads:
                out.update(t for t in (x, *(x[:k] + "*" for k in STARTS if len(x) > k)) if t in w)
        return out

    def inner(self, word: str) -> set[str]:
        """The terms that begin anywhere in a restored run of letters; a whole word counts where it stands, as the run does not show its end."""
        out = set()
        for at in range(len(word) - 3):
            if word[at : at + 4] in self.heads:
                rest = word[at:]
                out.update(t for k in range(4, min(len(rest), self.longest) + 1) for t in (rest[:k], rest[:k] + "*") if t in self.weights and (t[-1] != "*" or len(rest) > k))
        return out

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        found = self.terms(set(WORD.findall(low)))
        for token in suspicious(low):
            words = self.decoder.restore(token)
            found |= self.terms(set(words))
            if SPACED.fullmatch(token):
                found = found.union(*map(self.inner, words))
        logit = self.prior + sum(self.weights[t] for t in found) if found else self.none
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns keep of every row, with its toxicity as score_col."""
    model = language_model(docs, text_col)
    weights, prior, none = lexicon(docs, labels, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.astype(np.float32), weights, prior, none))
    cols = list(dict.fromkeys([*keep, text_col]))
    at, out = cols.index(text_col), [cols.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in batches:
            scores = [scorer.score(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in out), pa.array(scores, pa.float64())], [*keep, score_col])

    rows = docs.select(*[F.col(f"`{c}`") for c in cols])
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{score_col}` double"])
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from 0.5).

    labels has doc_id and toxic; rows with a null in either are ignored, and of several labels of a document the highest counts. Null and empty
    texts get the score of a text without toxic terms. A null identifier is not held out. Without labelled rows every
    score is low. Other columns of docs are ignored.
    """
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns. Each row is judged by its own text, whatever its doc_id: repeated rows go or
    stay together, null texts stay. An empty table stays empty."""
    score = free("toxicity", docs)
    return scored(docs, labels, docs.columns, score_col=score).filter(F.col(score) < 0.5).drop(score)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
