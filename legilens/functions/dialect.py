"""SQL text for two engines: expressions are written once against these primitives.

The engine of the library is Spark; the other dialect is DuckDB's, in which the registered queries are checked.
"""

from __future__ import annotations


class Spark:
    """Primitives of Spark SQL."""

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    @staticmethod
    def chars(s: str) -> str:
        return f"split({s}, '')"

    @staticmethod
    def words(s: str) -> str:
        return f"split({s}, {Spark.lit(SPACE)})"

    @staticmethod
    def split(s: str, on: str) -> str:
        return f"split({s}, {Spark.lit(re_quote(on))}, -1)"

    @staticmethod
    def filter(a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    @staticmethod
    def transform(a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    @staticmethod
    def let(v: str, value: str, body: str) -> str:
        """body with v bound to value, which is computed once."""
        return f"element_at(transform(array({value}), {v} -> {body}), 1)"

    @staticmethod
    def any(a: str, v: str, body: str) -> str:
        return f"exists({a}, {v} -> {body})"

    @staticmethod
    def all(a: str, v: str, body: str) -> str:
        return f"forall({a}, {v} -> {body})"

    @staticmethod
    def size(a: str) -> str:
        return f"size({a})"

    @staticmethod
    def at(a: str, i: str) -> str:
        """Element i from 1, null beyond the ends."""
        return f"get({a}, cast({i} as int) - 1)"

    @staticmethod
    def last(a: str) -> str:
        return f"element_at({a}, -1)"

    @staticmethod
    def join(a: str, sep: str) -> str:
        return f"array_join({a}, {Spark.lit(sep)})"

    @staticmethod
    def distinct(a: str) -> str:
        return f"array_distinct({a})"

    @staticmethod
    def total(a: str) -> str:
        return f"aggregate({a}, 0D, (s, v) -> s + v)"

    @staticmethod
    def greatest_of(a: str) -> str:
        return f"array_max({a})"

    @staticmethod
    def least_of(a: str) -> str:
        return f"array_min({a})"

    @staticmethod
    def seq(low: str, high: str) -> str:
        """low..high, empty if high < low."""
        return f"(case when ({high}) < ({low}) then cast(array() as array<int>) else sequence(cast({low} as int), cast({high} as int)) end)"

    @staticmethod
    def struct(**fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def matches(s: str, pattern: str) -> str:
        if pattern.endswith("$"):  # in Java $ also stands before a last line break
            pattern = pattern[:-1] + r"\z"
        return f"({s} rlike {Spark.lit(pattern)})"

    @staticmethod
    def without(s: str, pattern: str) -> str:
        return f"regexp_replace({s}, {Spark.lit(pattern)}, '')"

    @staticmethod
    def extract(s: str, pattern: str, group: int) -> str:
        """The group of the first match, or the empty string."""
        return f"regexp_extract({s}, {Spark.lit(pattern)}, {group})"

    @staticmethod
    def starts(s: str, with_: str) -> str:
        return f"startswith({s}, {with_})"

    @staticmethod
    def ends(s: str, with_: str) -> str:
        return f"endswith({s}, {with_})"

    @staticmethod
    def sub(s: str, at: str, n: str) -> str:
        return f"substring({s}, cast({at} as int), cast({n} as int))"

    @staticmethod
    def repeat(s: str, n: str) -> str:
        return f"repeat({s}, cast({n} as int))"

    @staticmethod
    def code(c: str) -> str:
        return f"ascii({c})"

    @staticmethod
    def levenshtein(a: str, b: str) -> str:
        return f"levenshtein({a}, {b})"

    @staticmethod
    def number(s: str) -> str:
        return f"try_cast({s} as double)"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    double, text, long, int = "double", "string", "bigint", "int"


class Duck:
    """The same primitives in DuckDB's SQL."""

    double, text, long, int = "double", "varchar", "bigint", "integer"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    @staticmethod
    def chars(s: str) -> str:
        return f"string_split({s}, '')"

    @staticmethod
    def words(s: str) -> str:
        return f"string_split_regex({s}, {Duck.lit(SPACE)})"

    @staticmethod
    def split(s: str, on: str) -> str:
        return f"string_split({s}, {Duck.lit(on)})"

    @staticmethod
    def filter(a: str, v: str, body: str) -> str:
        return f"list_filter({a}, lambda {v}: {body})"

    @staticmethod
    def transform(a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})"

    @staticmethod
    def let(v: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {v}: {body})[1]"

    @staticmethod
    def any(a: str, v: str, body: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: {body})) > 0)"

    @staticmethod
    def all(a: str, v: str, body: str) -> str:
        return f"(len(list_filter({a}, lambda {v}: not ({body}))) = 0)"

    @staticmethod
    def size(a: str) -> str:
        return f"len({a})"

    @staticmethod
    def at(a: str, i: str) -> str:
        return f"({a})[{i}]"

    @staticmethod
    def last(a: str) -> str:
        return f"({a})[-1]"

    @staticmethod
    def join(a: str, sep: str) -> str:
        return f"coalesce(array_to_string({a}, {Duck.lit(sep)}), '')"

    @staticmethod
    def distinct(a: str) -> str:
        return f"list_distinct({a})"

    @staticmethod
    def total(a: str) -> str:
        return f"coalesce(list_sum({a}), 0.0)"

    @staticmethod
    def greatest_of(a: str) -> str:
        return f"list_max({a})"

    @staticmethod
    def least_of(a: str) -> str:
        return f"list_min({a})"

    @staticmethod
    def seq(low: str, high: str) -> str:
        return f"generate_series(({low})::bigint, ({high})::bigint)"

    @staticmethod
    def struct(**fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    @staticmethod
    def array(*items: str) -> str:
        return f"[{', '.join(items)}]"

    @staticmethod
    def matches(s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {Duck.lit(pattern)})"

    @staticmethod
    def without(s: str, pattern: str) -> str:
        return f"regexp_replace({s}, {Duck.lit(pattern)}, '', 'g')"

    @staticmethod
    def extract(s: str, pattern: str, group: int) -> str:
        return f"coalesce(regexp_extract({s}, {Duck.lit(pattern)}, {group}), '')"

    @staticmethod
    def starts(s: str, with_: str) -> str:
        return f"starts_with({s}, {with_})"

    @staticmethod
    def ends(s: str, with_: str) -> str:
        return f"ends_with({s}, {with_})"

    @staticmethod
    def sub(s: str, at: str, n: str) -> str:
        return f"substring({s}, ({at})::bigint, ({n})::bigint)"

    @staticmethod
    def repeat(s: str, n: str) -> str:
        return f"repeat({s}, ({n})::bigint)"

    @staticmethod
    def code(c: str) -> str:
        return f"unicode({c})"

    @staticmethod
    def levenshtein(a: str, b: str) -> str:
        # Counts bytes: one sign for every character beyond ASCII makes it count characters, as the other side is ASCII.
        return f"levenshtein(regexp_replace({a}, '[^\\x00-\\x7F]', '~', 'g'), {b})"

    @staticmethod
    def number(s: str) -> str:
        return f"try_cast({s} as double)"

    @staticmethod
    def idiv(a: str, b: str) -> str:
        return f"(({a}) // ({b}))"


#: Runs of ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def re_quote(s: str) -> str:
    """A literal as a regular expression."""
    return "".join("\\" + c if c in r".^$*+?()[]{}|\/" else c for c in s)


Dialect = type[Spark] | type[Duck]
