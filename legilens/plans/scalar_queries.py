"""Queries of the scalar functions: each is applied to every distinct token, to every row of a numeric table, or to paths and keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legilens.functions import dictionaries as known
from legilens.functions import scalars as f
from legilens.functions.dialect import Dialect, Duck, Spark
from legilens.plans import planting

Columns = Callable[[Dialect], dict[str, str]]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _over_tokens(name: str, columns: Columns) -> None:
    """Register columns over the tokens: the result has the token's md5, never the token."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = columns(Spark)
        return planting.tokens(spark, sf_dir).select("token_key", *[F.expr(v).alias(k) for k, v in made.items()])

    QUERIES[name] = query
    SQL[name] = "select token_key, " + ", ".join(f"{v} as {k}" for k, v in columns(Duck).items()) + f" from ({planting.TOKENS_SQL}) t"


def _over_table(name: str, table: str, keys: tuple[str, ...], columns: Columns) -> None:
    """Register columns over all rows of a table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return rows.select(*keys, *[F.expr(v).alias(k) for k, v in columns(Spark).items()])

    QUERIES[name] = query
    SQL[name] = "select " + ", ".join([*keys, *(f"{v} as {k}" for k, v in columns(Duck).items())]) + f" from {table}"


def rounded(x: str) -> str:
    return f"round(cast({x} as double), 6)"


T = "token"
_over_tokens("normalize_unicode", lambda d: {"folded": f"md5({f.normalize_unicode(T, d)})"})
_over_tokens("confusion_class", lambda d: {"folded": f"md5({f.confusion_class(T, d)})"})
_over_tokens("normalize_confusable", lambda d: {"folded": f"md5({f.normalize_confusable(T, d)})"})
_over_tokens("normalize_confusable_keep_len", lambda d: {"folded": f"md5({f.confusion_class(T, d)})", "len": f"cast(length({f.confusion_class(T, d)}) as {d.int})"})
_over_tokens("find_all_confusable", lambda d: {"places": d.join(d.transform(f.find_all(T, "on", d), "p", f"cast(p as {d.text})"), ",")})
_over_tokens("levenshtein_within", lambda d: {"distance": f"cast({f.levenshtein_within(T, d.lit('sk-proj-'), '4', d)} as {d.int})"})
_over_tokens("fuzzy_prefix_match", lambda d: {f"p{k}": f"cast({f.fuzzy_prefix(T, p, 2, d)} as {d.int})" for k, p in enumerate(("sk-proj-", "ghp_", "AKIA", "pk_live_"))})
_over_tokens("secret_charset_ratio", lambda d: {"ratio": rounded(f.secret_charset_ratio(T, d))})
_over_tokens("shannon_entropy", lambda d: {"bits": rounded(f.shannon(T, d))})
_over_tokens("char_composition", lambda d: {f"n_{k}": v for k, v in f.composition(T, d).items()} | {"classes": f.classes_present(T, d)})
_over_tokens("hex_digit_predicates", lambda d: {"all_hex": f.is_all_hex(T, d), "all_digits": f.is_all_digits(T, d)})
_over_tokens("wordlike", lambda d: {"is_wordlike": f.is_wordlike(T, d)})
_over_tokens("longest_same_char_run", lambda d: {"run": f"cast({f.longest_same_run(T, d)} as {d.int})"})
_over_tokens("distinct_ratio", lambda d: {"ratio": rounded(f.distinct_ratio(T, d))})
_over_tokens("randomness_score", lambda d: {"score": rounded(f.randomness(T, d))})
_over_tokens("body_charset_ratio", lambda d: {k: rounded(f.charset_ratio(T, c, d)) for k, c in known.CHARSETS.items()})
_over_tokens("monotonic_run", lambda d: {"run": f"cast({f.longest_monotonic_run(T, d)} as {d.int})", "long": f"{f.longest_monotonic_run(T, d)} >= 8"})
for _reason, _test in f.REJECTIONS:
    _name = {"content-hash-filename": "content_hash", "ip-address": "ip", "mime-or-encoding": "mime"}.get(_reason, _reason.replace("-", "_"))
    _over_tokens(f"reject_{_name}", lambda d, test=_test: {"rejected": test(T, d)})
_over_tokens("is_code_reference", lambda d: {"is_reference": f.is_code_reference(T, d)})
_over_tokens("structural_rejection", lambda d: {"reason": f.structural_rejection(T, d)})
_over_tokens("mask_token", lambda d: {"preview": f.mask(T, "3", d)})
_over_tokens("shell_quote", lambda d: {"quoted": f"md5({f.shell_quote(T, d)})"})
_over_tokens("fuzzy_vs_exact", lambda d: {"exact": d.matches(T, "^sk-proj-[A-Za-z0-9_-]{20,}$"), "fuzzy": f"({f.fuzzy_prefix(T, 'sk-proj-', 2, d)}) is not null"})


def _rejection_histogram(d: Dialect, source: str) -> str:
    return f"select coalesce({f.structural_rejection(T, d)}, 'none') as reason, count(*) as n from ({source}) t group by 1"


def rejection_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = planting.tokens(spark, sf_dir).select(F.coalesce(F.expr(f.structural_rejection(T, Spark)), F.lit("none")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


QUERIES["rejection_histogram"] = rejection_histogram
SQL["rejection_histogram"] = _rejection_histogram(Duck, planting.TOKENS_SQL)

# Plans of a recording from the parts' sizes: 1 to 50 points, scale 1 or 2 (0 for every 37th part), heights by the key.
FONT, SCALE = "cast(p_size as double)", "cast(case when p_partkey % 37 = 0 then 0 else 1 + p_partkey % 2 end as double)"
CAPTURE, EXPORT = "(p_partkey % 5 * 540)", "(p_partkey % 7 * 360)"


def _verdict(d: Dialect) -> dict[str, str]:
    before = f.glyph_before(FONT, SCALE, d)
    ratio = f.export_ratio(CAPTURE, EXPORT, d)
    after = f"({before} * {ratio})"
    return {
        "glyph_px": rounded(after),
        "glyph_px_before_export": rounded(before),
        "export_ratio": rounded(ratio),
        "legibility": f.judge(after, d),
        "export_is_the_problem": f"({before} >= {f.COMFORTABLE} and {after} < {f.COMFORTABLE})",
    }


_over_table("legibility_judge", "part", ("p_partkey",), lambda d: {"legibility": f.judge(f"({FONT} * 0.7)", d)})
_over_table("evaluate_plan", "part", ("p_partkey",), _verdict)
_over_table("min_font_points", "part", ("p_partkey",), lambda d: {"points": rounded(f.min_font_points(f"({SCALE} * p_size / 10.0)", d))})
_over_table("safe_export_height", "part", ("p_partkey",), lambda d: {"height": f.safe_export_height(FONT, SCALE, CAPTURE, d)})
_over_table("recording_plan_report", "part", ("p_partkey",), lambda d: _verdict(d) | {"safe_height": f.safe_export_height(FONT, SCALE, CAPTURE, d)})
_over_table("format_timestamp", "lineitem", ("l_orderkey", "l_linenumber"), lambda d: {"shown": f.format_timestamp("(l_orderkey * 977 + l_linenumber * 61000)", d)})
_over_table("format_visible_for", "lineitem", ("l_orderkey", "l_linenumber"), lambda d: {"shown": f.format_visible_for("(l_orderkey * 37 % 400000)", d)})
_over_table("glyph_pixels", "part", ("p_partkey",), lambda d: {"px": rounded(f"{FONT} * 1.5 * cos(radians(p_partkey % 80)) * cos(radians(p_partkey % 45))")})

# Paths, keys and names made from the parts' keys.
PATH = "concat('/rec/', p_partkey, case p_partkey % 6 when 0 then '.mov' when 1 then '.MP4' when 2 then '.m4v' when 3 then '.mp4.txt' when 4 then '' else '/mov' end)"
KEY = "concat(case p_partkey % 5 when 0 then 'frames_' when 1 then 'cloud_model_' when 2 then 'scan_fps' when 3 then 'theme' else 'excluded_' end, p_partkey % 50)"
FPS = "case p_partkey % 6 when 0 then '0.5' when 1 then '2' when 2 then '-1' when 3 then 'fast' when 4 then 'Infinity' end"
_over_table("video_extension_filter", "part", ("p_partkey",), lambda d: {"is_video": f.is_video(PATH, d)})
_over_table("settings_obsolete_filter", "part", ("p_partkey",), lambda d: {"is_obsolete": f.is_obsolete_setting(KEY, d)})
_over_table("scan_fps_setting", "part", ("p_partkey",), lambda d: {"fps": f.fps_or_default(FPS, d)})
_over_table(
    "resolve_save_location", "part", ("p_partkey",),
    lambda d: {"folder": f.save_location("case p_partkey % 5 when 0 then '' when 1 then '~/Movies/' when 2 then '/Volumes/x//' when 3 then ' /tmp ' end", "'/Users/erin'", d)},
)
_over_table("shorten_home", "part", ("p_partkey",), lambda d: {"shown": f.shorten_home(f"concat(case p_partkey % 3 when 0 then '/Users/u' when 1 then '/Users/' else '/Volumes/' end, p_partkey, case p_partkey % 2 when 0 then '/Desktop' else '' end)", d)})
_over_table("display_phrase", "part", ("p_partkey",), lambda d: {"shown": f.display_phrase("case when p_partkey % 7 = 0 then null else p_size * 64 end", "(p_size * 36 * (p_partkey % 5))", "(p_size / 10.0)", d)})
_over_table("initials_from_name", "supplier", ("s_suppkey",), lambda d: {"initials": f.initials("translate(s_name, '#', ' ')", d)})
