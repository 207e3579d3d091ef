"""Personal data: fixed patterns, and terms that give a protected entity away.

The patterns find e-mail addresses, IPv4 addresses, payment cards and telephone numbers: the protected entities. A term in a text
with an entity reveals it as far as seeing the term makes the entity likelier: with document counts over the whole corpus, the
pointwise mutual information log(p(entity, term) / (p(entity) p(term))), as a share of the entity's own information -log p(entity).
At share 1 the term occurs with no other context: it identifies the entity. Wherever they occur, in any text, terms from REMOVE on
are removed, from GENERALISE on they are replaced by their form.

Two aggregations give the counts: pairs of entity and term, from the texts with an entity, and documents by term, from all words of all
texts, kept to those terms by a bit filter of fixed size. A second pass over all texts finds the occurrences of the telling terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import bit_filter, filter_bytes, in_filter, saved

KINDS = ("email", "ip", "card", "phone", "term")
#: Least length of a term.
LETTERS = 4
#: Documents that must hold entity and term together: fewer are no co-occurrence but a single sentence.
SUPPORT = 2
#: Disclosure, as a share of the entity's information, from which a term is generalised or removed.
GENERALISE, REMOVE = 0.7, 0.9
#: Terms that a worker remembers.
REMEMBERED = 500_000
#: Bits of the filters of entities and terms: 8 MB.
TERM_BITS = 1 << 26

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses. Each @ is looked at once, so long runs without one cost nothing."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    return out


def addresses(text: str) -> list[Span]:
    """Groups of four parts in chains of dotted numbers; those with a part over 255 are dropped."""
    out = []
    for m in DOTTED.finditer(text):
        if text.count(".", m.start(), m.end()) >= 3:
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((at, 1, end))
                at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of all pattern matches, sorted by start, then kind."""
    out = emails(text) if "@" in text else []
    if DIGITS.search(text):
        out += addresses(text)
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m.group())) <= 15]
    return sorted(out)


def terms_in(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of each word of a text that may be a term and is not within an entity."""
    k = 0
    ends = sorted((s, e) for s, _, e in spans)
    reach = 0
    for m in WORD.finditer(text):
        start, end = m.span()
        while k < len(ends) and ends[k][0] < end:
            reach = max(reach, ends[k][1])
            k += 1
        if start >= reach and LETTERS <= end - start <= 40:
            yield m.group().lower(), start, end


def beside(docs: DataFrame, text_col: str) -> DataFrame:
    """(entities, terms), both distinct, of every row with an entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entities, terms = [], []
            for text in b.column(0).to_pylist():
                if spans := base_spans(text or ""):
                    entities.append(sorted({f"{KINDS[kind]}:{text[start:end].lower()}" for start, kind, end in spans}))
                    terms.append(sorted({t for t, _, _ in terms_in(text, spans)}))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(pa.string())) for v in (entities, terms)], ["entities", "terms"])

    return docs.select(text_col).mapInArrow(run, "entities array<string>, terms array<string>")


def disclosure(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, share): how much of an entity's information each term of the texts with it gives away at most, where that is enough to act on."""
    held = saved(beside(docs, text_col), "beside")
    # An entity of fewer than SUPPORT texts has no term with that support.
    by_entity = saved(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= SUPPORT), "entities")
    often = in_filter(held.select(F.explode("entities").alias("entity"), "terms"), "entity", bit_filter(by_entity, "entity", TERM_BITS), TERM_BITS)
    pairs = often.select("entity", F.explode("terms").alias("term"))
    together = saved(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= SUPPORT), "together")
    terms = together.select("term").distinct()
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))).alias("term"))
    known = in_filter(words.filter(f"length(term) between {LETTERS} and 40"), "term", bit_filter(terms, "term", TERM_BITS), TERM_BITS)
    by_term = known.groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("total"))  # one row
    counted = together.join(by_entity, "entity").join(by_term, "term").join(F.broadcast(total))
    # A term counted beside an entity is in that document, so n_term is at least n_both; case folding may differ between engines.
    n_term = F.greatest("n_term", "n_both")
    gain = F.log(F.col("n_both") * F.col("total") / (F.col("n_entity") * n_term))
    own = F.log(F.col("total") / F.col("n_entity"))
    share = F.when(own > 0, gain / own).otherwise(0.0)
    return counted.select("term", share.alias("share")).filter(F.col("share") >= GENERALISE).groupBy("term").agg(F.max("share").alias("share"))


def occurrences(docs: DataFrame, telling: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, base array<start, kind, end>, near array<term, start, end>) of every row; row is unique, near are words that may be telling."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_bytes(bit_filter(telling, "term", TERM_BITS), TERM_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        near = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        bits, seen = sent.value, {}

        def maybe(term: str) -> bool:
            if (hit := seen.get(term)) is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                # Spark's xxhash64 of a string, see slot_of.
                slot = xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), 42) & (TERM_BITS - 1)
                hit = seen[term] = bool(bits[slot >> 3] >> (slot & 7) & 1)
            return hit

        for b in batches:
            base, around = [], []
            for text in b.column(1).to_pylist():
                spans = base_spans(text or "")
                base.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans])
                around.append([dict(zip(("term", "start", "end"), t, strict=True)) for t in terms_in(text or "", spans) if maybe(t[0])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, span), pa.array(around, near)], ["doc_id", "base", "near"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, near array<struct<term:string,start:int,end:int>>"
    rows = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, schema)
    return rows.withColumn("row", F.monotonically_increasing_id())


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: row, doc_id, base and terms, arrays of (start, kind, end) and (start, end, share) by start.

    Null texts count as empty and have no spans; repeated rows are counted and answered each. Other columns are ignored.
    """
    telling = saved(disclosure(docs, text_col), "telling")
    looked = saved(occurrences(docs, telling, id_col, text_col), "looked")
    near = looked.select("row", F.explode("near").alias("n")).select("row", "n.*")
    marked = near.join(telling, "term").select("row", F.struct("start", "end", "share").alias("t"))
    terms = marked.groupBy("row").agg(F.array_sort(F.collect_list("t")).alias("terms"))
    return looked.select("row", "doc_id", "base").join(terms, "row", "left").withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,end:int,share:double>>)")))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, clean): entities become [kind], terms that tell too much [word], [Name] or nothing. doc_id must be unique."""
    found = private_spans(docs, id_col, text_col)
    joined = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(found.drop("row"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = []
            for text, base, terms in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                cuts = [(s["start"], s["end"], f"[{KINDS[s['kind']]}]") for s in base]
                for t in terms:
                    form = "[Name]" if text[t["start"]].isupper() else "[word]"
                    cuts.append((t["start"], t["end"], "" if t["share"] >= REMOVE else form))
                out, at = [], 0
                for start, end, instead in sorted(cuts):
                    if start >= at:
                        out += [text[at:start], instead]
                    at = max(at, end)
                clean.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clean, pa.string())], ["doc_id", "text", "clean"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.select("doc_id", "text", "base", "terms").mapInArrow(run, f"doc_id {kind}, text string, clean string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each pattern and for terms, base_sha256 and spans of every row."""
    found = private_spans(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.transform("base", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    extra = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))
    every = F.transform(F.array_sort(F.concat("base", extra)), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
        F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def op5_pii_sanitise(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
