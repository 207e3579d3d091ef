"""Fill-in-middle transformation by lookaround splitting, in built-in functions only.

A unit grammar says which characters form runs; every other character is a unit of its own. Between two neighbours there is a boundary unless both
are of one run's class, which is a zero-width regular expression: a character behind, a character ahead, and not the same class on both sides. Spark's
split at it returns all units and loses nothing; it would give one empty unit for the empty text, which is told apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legilens.llm.shared import free

#: Insides of the character classes whose runs are one unit, by the grammar's name.
GRAMMARS: dict[str, tuple[str, ...]] = {
    "letters": ("A-Za-z",),
    "letters_and_digits": ("A-Za-z", "0-9"),
    "words": (r"\S",),
    "lines": (r"^\n",),
    "characters": (),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are transformed, and of a hundred of those so many are written suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def boundary(runs: Sequence[str]) -> str:
    """The zero-width pattern of where one unit ends and the next begins. A character beyond 16 bits is one character."""
    both = "".join(f"(?!(?<=[{c}])(?=[{c}]))" for c in runs)
    return rf"(?s)(?<=.)(?=.)(?!(?<=[\x{{D800}}-\x{{DBFF}}])(?=[\x{{DC00}}-\x{{DFFF}}])){both}"


def units(text: Column, grammar: str = "letters") -> Column:
    """The units of a text in order; none of the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(GRAMMARS[grammar]), -1))


def draw(ident: Column, k: int, seed: int) -> Column:
    """The k-th number of 32 bits, from 1, that stands for a row: of the hex SHA-256 of seed:identifier."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digits, 8 * k - 7, 8), 16, 10).cast("long")


def rebuilt(output: Column, form: Column) -> Column:
    """The text that an output was made of. The three signs stand in a transformed output once each."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: str = "letters", seed: int = 1) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; names that docs has already get a _ behind them.

    Two draws of a row, modulo its units and one, say where the middle begins and ends; a third whether the row is transformed; a fourth whether suffix or prefix
    comes first. form is psm, spm, or plain where the text stays: when it is empty or null (which counts as empty; the output is then empty), when it contains one of the signs,
    or when the draw says so; prefix_chars and middle_chars are then null. Rows are judged one by one: repeated rows get equal results, a null identifier draws
    as an empty one, texts of any length are taken whole, and an empty table gives no rows.
    """
    names = {c: free(c, docs) for c in ("n", "form", "prefix_chars", "middle_chars", "output", "whole", "units", "from", "to", "prefix", "middle", "suffix")}
    col = {k: F.col(v) for k, v in names.items()}
    h1, h2, h3, h4 = (draw(F.col(f"`{id_col}`"), k, seed) for k in (1, 2, 3, 4))
    rows = docs.withColumn(names["whole"], F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = rows.withColumn(names["units"], units(col["whole"], grammar)).withColumn(names["n"], F.size(names["units"]).cast("long"))
    cuts = [h % (col["n"] + 1) for h in (h1, h2)]
    rows = rows.withColumns({names["from"]: F.least(*cuts).cast("int"), names["to"]: F.greatest(*cuts).cast("int")})
    signs = [F.contains(col["whole"], F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (col["whole"] == "") | signs[0] | signs[1] | signs[2] | (h3 % 100 >= TRANSFORMED)
    rows = rows.withColumn(names["form"], F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    piece = lambda start, length: F.array_join(F.slice(col["units"], start, length), "")
    # Lengths of the first two pieces tell where the text is cut, so the last is taken from the text itself.
    rows = rows.withColumns({names["prefix"]: piece(F.lit(1), col["from"]), names["middle"]: piece(col["from"] + 1, col["to"] - col["from"])})
    lengths = {k: F.length(col[k]) for k in ("prefix", "middle")}
    rows = rows.withColumn(names["suffix"], F.substring(col["whole"], lengths["prefix"] + lengths["middle"] + 1, F.length(col["whole"])))
    sign = {k: F.lit(v) for k, v in (("prefix", PREFIX), ("suffix", SUFFIX), ("middle", MIDDLE))}
    joined = lambda *order: F.concat(*[x for k in order for x in (sign[k], col[k])])
    whole = F.when(col["form"] == "plain", col["whole"]).when(col["form"] == "psm", joined("prefix", "suffix", "middle")).otherwise(joined("suffix", "prefix", "middle"))
    counts = {names[f"{k}_chars"]: F.when(col["form"] != "plain", v.cast("long")) for k, v in lengths.items()}
    rows = rows.withColumns({names["output"]: whole, **counts})
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[names[c] for c in ("n", "form", "prefix_chars", "middle_chars", "output")])


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = rebuilt(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


SQL = f"""
with u as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || coalesce(doc_id::varchar, '')) as digest from documents
), h as (
  select *, len(units) as n, [('0x' || substring(digest, 8 * k + 1, 8))::bigint for k in range(4)] as h from u
), c as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h[3] % 100 >= {TRANSFORMED} then 'plain'
      when h[4] % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from h
), p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
