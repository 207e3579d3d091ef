"""Detectors: text in, masked findings out. No output holds the body of a secret.

Candidates are found once per text; the provider patterns are a broadcast dimension of fixed size joined on the numbers of the prefixes that
the automaton found where a candidate begins, or on the class of its first character where it wasn't asked, which turns the comparison with
every prefix into an equi-join. Cheap tests come before dear ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legilens.functions import dictionaries as known
from legilens.functions import scalars as f
from legilens.functions.dialect import Spark
from legilens.operators import candidates, patterns
from legilens.operators.patterns import Patterns
from legilens.sources.scratch import stored

FINDING = ("pattern_id", "label", "provider", "severity", "severity_rank", "start", "end", "preview", "confidence", "token_len")


def normalised(rows: DataFrame) -> DataFrame:
    """(id, text) with the characters of the text folded."""
    return rows.select("id", F.expr(f.normalize_unicode("text", Spark)).alias("text"))


def rejected_reason() -> Column:
    return F.expr(f.structural_rejection("token", Spark))


#: What a prefix must pass, from cheap to dear: a name and its value, null where it didn't pass what stands before.
HEAD = f.normalize_confusable("substring(token, 1, n)", Spark)
STEPS = (
    ("low", "greatest(1, prefix_len - tolerance)"),
    ("high", "least(prefix_len + tolerance, length(token))"),
    ("best", f"if(low <= high, array_min(transform(sequence(low, high), n -> named_struct('d', levenshtein({HEAD}, folded), 'off', abs(n - prefix_len), 'n', n))), null)"),
    ("body", "if(best.d <= tolerance, substring(token, best.n + 1), null)"),
    ("ratio", "if(length(body) between body_min and body_max, cast(length(regexp_replace(body, concat('[^', charset, ']'), '')) as double) / nullif(length(body), 0), null)"),
    ("random", f"if(ratio >= 0.85D, {f.randomness('body', Spark)}, null)"),
)
CONFIDENCE = "least(1D, 0.45D * if(startswith(token, prefix), 1D, 0.75D) + 0.30D * ratio + 0.25D * random)"
#: Fold over a list of m (confidence, longest) in the order of the patterns: a later one wins by 0.05, or within 0.05 with a longer prefix.
FOLD = (
    "aggregate(slice({a}, 2, greatest(size({a}), 1)), get({a}, 0).m, (b, x) -> if(x.m.confidence > b.confidence + 0.05D"
    " or (x.m.longest > b.longest and x.m.confidence + 0.05D >= b.confidence), x.m, b))"
)


def tried(rows: DataFrame, spare: str | None = None, among: Patterns = known.PATTERNS) -> DataFrame:
    """rows (with token) beside each prefix that accepts them, with confidence. Rows for which spare holds stay without a prefix as well.

    Rows with tries are tried with the prefixes of those numbers, others with all that begin as they do. All steps are one value that a generator gives:
    as columns, each filter's value would hold those of the steps before as often as they are named, and the last would compare prefixes 79 times.
    """
    dim = F.broadcast(patterns.dimension(rows.sparkSession, among))  # a row for each prefix, at most patterns.MOST
    if "tries" in rows.columns:
        out, by = rows.withColumn("number", F.explode_outer("tries")).drop("tries"), "number"
    else:
        out, by = rows.withColumn("anchor", F.expr(f.confusion_class("substring(token, 1, 1)", Spark))), "anchor"
    steps = "named_struct('best', best, 'confidence', if(random >= min_randomness, " + CONFIDENCE + ", null))"
    for name, value in reversed(STEPS):
        steps = Spark.let(name, value, steps)
    passed = "x.confidence is not null" + (f" or {spare}" if spare else "")
    return out.join(dim, by, "left" if spare else "inner").select("*", F.inline(F.expr(f"filter(array({steps}), x -> {passed})")))


def matched(cands: DataFrame, among: Patterns = known.PATTERNS) -> DataFrame:
    """(id, seq, pattern_ord, m) of each candidate's best prefix for each pattern that accepts it."""
    kept = ["token", "pattern_id", "label", "provider", "severity", "severity_rank", "start", "end", F.col("best.n").alias("consumed"), "confidence", "longest"]
    best = F.max_by(F.struct(*kept), F.struct("confidence", -F.col("prefix_ord"))).alias("m")
    return tried(cands, among=among).groupBy("id", "seq", "pattern_ord").agg(best)


def best_pattern(matches: DataFrame) -> DataFrame:
    """(id, seq, m): each candidate's best pattern."""
    listed = matches.groupBy("id", "seq").agg(F.array_sort(F.collect_list(F.struct("pattern_ord", "m"))).alias("a"))
    return listed.select("id", "seq", F.expr(FOLD.format(a="a")).alias("m"))


def shape(**values: str) -> str:
    """SQL: a finding."""
    kinds = {"severity_rank": "int", "start": "int", "end": "int", "confidence": "double", "token_len": "int"}
    values["severity_rank"] = values.get("severity_rank") or str(known.SEVERITIES.index(values["severity"].strip("'")))
    return "named_struct(" + ", ".join(f"'{k}', cast({values[k]} as {kinds.get(k, 'string')})" for k in FINDING) + ")"


def private_key() -> str:
    """SQL: the finding of a header of a private key."""
    return shape(
        pattern_id="'private_key'", label="'Private key'", provider="'PEM'", severity="'critical'", start="start", end="end", preview="'-----BEGIN •••••• PRIVATE KEY-----'",
        confidence="0.98D", token_len="length(token)",
    )


def db_uri() -> tuple[str, str]:
    """SQL: whether a candidate is a connection string with a password of at least 4 characters that is no placeholder, and the finding."""
    low = f.lower("token", Spark)
    scheme = "try_element_at(filter(array(" + ", ".join(f"'{s}'" for s in known.SCHEMES) + f"), s -> startswith({low}, s)), 1)"
    authority = f"substring_index(substring(token, length({scheme}) + 1), '@', 1)"
    password = f"substring({authority}, locate(':', {authority}) + 1)"
    test = (
        f"{f.any_of(f'substring({low}, 1, 14)', known.SCHEMES, Spark)} and contains(substring(token, length({scheme}) + 1), '@') and contains({authority}, ':')"
        f" and length({password}) >= 4 and not {f.is_placeholder(password, Spark)}"
    )
    return f"coalesce({test}, false)", shape(
        pattern_id="'db_uri'", label="'Connection string with password'", provider=f"replace({scheme}, '://', '')", severity="'critical'", start="start", end="end",
        preview=f"concat({scheme}, '•••••••@…')", confidence="0.92D", token_len="length(token)",
    )


def web_token() -> tuple[str, str]:
    """SQL: whether a candidate is a token of three base64 parts that begins like a header, and the finding."""
    parts, part = Spark.split("token", "."), f"length(p) >= 8 and {f.charset_ratio('p', known.CHARSETS['base64url'], Spark)} >= 0.9"
    test = f"startswith(token, 'eyJ') and size({parts}) = 3 and forall({parts}, p -> {part}) and not {f.is_placeholder('token', Spark)}"
    return f"coalesce({test}, false)", shape(
        pattern_id="'jwt'", label="'JSON Web Token'", provider="'JWT'", severity="'high'", start="start", end="end", preview=f.mask("token", "6", Spark), confidence="0.88D", token_len="length(token)",
    )


#: The keyword with the number word.
KEYWORD = "get(array(" + ", ".join(f"'{k}'" for k in known.KEYWORDS) + "), word)"


def with_values(items: DataFrame) -> DataFrame:
    """items with value, what the keyword before the token is assigned where that is credible (else null), and its place in the text, value_start."""
    spaced = ", ".join(str(known.KEYWORDS.index(k)) for k in known.SPACED)
    white = Spark.lit(f"^[{known.WHITE}]+")
    bare = "regexp_replace(quoted, " + Spark.lit("^[\"'`]+|[\"'`]+$") + ", '')"
    word = f"regexp_extract({bare}, {Spark.lit(f'[^{known.WHITE}]+')}, 0)"
    steps = {
        "trimmed": f"if(kind = 3, regexp_replace(token, {white}, ''), null)",
        "spaced": f"word in ({spaced}) and length(token) > length(trimmed)",
        "rest": "if(trimmed <> '' and (substring(trimmed, 1, 1) in ('=', ':') or spaced), if(spaced, trimmed, substring(trimmed, 2)), null)",
        "quoted": f"regexp_replace(rest, {white}, '')",
        "value": f"regexp_replace({word}, {Spark.lit('[;,.)' + chr(34) + chr(39) + '`]+$')}, '')",
    }
    for name, value in steps.items():
        items = items.withColumn(name, F.expr(value))
    credible = (
        f"length(value) >= 8 and ({f.structural_rejection('value', Spark)}) is null and not {f.is_code_reference('value', Spark)}"
        f" and {f.secret_charset_ratio('value', Spark)} >= 0.85 and not {f.is_wordlike('value', Spark)} and {f.randomness('value', Spark)} >= 0.5"
    )
    items = items.withColumn("value", F.expr(f"if({credible}, value, null)"))
    return items.withColumn("value_start", F.expr("start + length(token) - length(quoted)")).drop(*[s for s in steps if s != "value"])


def assigned() -> str:
    """SQL: the finding of a value assigned to a keyword."""
    return shape(
        pattern_id="'assignment'", label=f"concat('Assigned secret (', {KEYWORD}, ')')", provider="'Generic'", severity="'high'", start="value_start", end="value_start + length(value)",
        preview=f.mask("value", "2", Spark), confidence=f"least(1D, 0.55D + 0.45D * {f.randomness('value', Spark)})", token_len="length(value)",
    )


def looked_at(rows: DataFrame, kind: str, among: Patterns) -> DataFrame:
    """The items of (id, text) with what each detector says of them: is_db, is_web, value, other (any of these, or a header), and each prefix that is tried on
    a candidate with sound, whether it accepts it. With kind reported every candidate stays, else those that a detector accepts."""
    is_db, is_web = db_uri()[0], web_token()[0]
    items = with_values(candidates.explode(normalised(rows), kind, among))
    told = items.withColumns({"is_db": F.expr(f"kind = 1 and {is_db}"), "is_web": F.expr(f"kind = 1 and {is_web}")}).withColumn("other", F.expr("kind = 0 or is_db or is_web or value is not null"))
    long = f"kind = 1 and length(token) >= {candidates.SHORTEST}"
    if kind == "reported":
        told = told.withColumn("reason", F.when(F.expr(long), rejected_reason()))
        found = tried(told.filter(f"other or {long}"), "true", among).withColumn("why", F.col("reason"))
    else:
        told = told.withColumn("why", F.when(F.expr(f"{long} and size(tries) > 0"), rejected_reason()))  # once for a candidate, not for each prefix
        found = tried(told.filter(f"other or {long}"), "other", among)
    found = found.withColumn("sound", F.expr(f"coalesce({long} and confidence is not null and why is null, false)"))
    return found if kind == "reported" else found.filter("other or sound")


def by_item(found: DataFrame, *more: Column) -> DataFrame:
    """(id, kind, seq, a, five): the findings of each item, one place of the list for each detector; of a candidate its best pattern. The only shuffle, by text."""
    key = shape(
        pattern_id="pattern_id", label="label", provider="provider", severity="severity", severity_rank="severity_rank", start="start", end="end", preview=f.mask("token", "best.n", Spark),
        confidence="confidence", token_len="length(token)",
    )
    listed = found.repartition("id").groupBy("id", "kind", "seq").agg(
        F.first(F.expr(f"if(kind = 0, {private_key()}, null)")).alias("pem"),
        F.first(F.expr(f"if(is_db, {db_uri()[1]}, null)")).alias("db"),
        F.first(F.expr(f"if(is_web, {web_token()[1]}, null)")).alias("web"),
        F.min(F.expr(f"if(value is null, null, struct(word as i, {assigned()} as f))")).alias("line"),
        F.array_sort(F.collect_list(F.expr(f"if(sound, struct(pattern_ord, -confidence as c, prefix_ord, struct(confidence, longest, {key} as f) as m), null)"))).alias("a"),
        *more,
    )
    listed = listed.withColumn("a", F.expr("filter(a, (x, i) -> i = 0 or get(a, i - 1).pattern_ord <> x.pattern_ord)"))  # each pattern's best prefix
    five = ", ".join(f"struct({k} as detector, {value} as f)" for k, value in enumerate(("pem", "db", "web", "line.f", f"({FOLD.format(a='a')}).f")))
    return listed.withColumn("five", F.expr(f"filter(array({five}), x -> x.f is not null)"))


def all_findings(rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(id, detector, seq, columns of FINDING): findings of all detectors over (id, text), overlaps included. table has the patterns to look for, the built-in ones if not given.

    One pass: texts are read and folded once, their items are looked at by every detector that they are for, and only what some detector accepts
    is shuffled, once, by text. Of a line the first keyword with a credible value counts; of a candidate its best pattern.
    """
    each = by_item(looked_at(rows, "detectable", patterns.compiled(table))).select("id", "seq", F.explode("five").alias("x"))
    return each.select("id", "x.detector", "seq", *[f"x.f.{c}" for c in FINDING])


def without_overlaps(findings: DataFrame) -> DataFrame:
    """Of overlapping findings of a text the most severe stays, then the most confident, then the first; places are half-open.

    Findings are cut into islands that share no place; each is folded on its own.
    """
    before = Window.partitionBy("id").orderBy("start", "end", "detector", "seq").rowsBetween(Window.unboundedPreceding, -1)
    to_here = before.rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce((F.col("start") >= F.max("end").over(before)).cast("int"), F.lit(1))
    told = findings.withColumn("new", new).withColumn("island", F.sum("new").over(to_here))
    order = F.struct(
        (-F.col("severity_rank")).alias("r"), (-F.round("confidence", 9)).alias("c"), F.col("start").alias("s"), F.col("detector").alias("d"), F.col("seq").alias("q"), F.struct(*FINDING).alias("f")
    )
    listed = told.groupBy("id", "island").agg(F.array_sort(F.collect_list(order)).alias("a"))
    none = "cast(array() as array<struct<" + ",".join(f"{x.name}:{x.dataType.simpleString()}" for x in findings.select(*FINDING).schema) + ">>)"
    kept = f"aggregate(transform(a, x -> x.f), {none}, (k, x) -> if(exists(k, y -> x.start < y.end and y.start < x.end), k, concat(k, array(x))))"
    return listed.select("id", F.explode(F.expr(kept)).alias("f")).select("id", "f.*")


def detect_in_text(rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Masked findings of each (id, text): id and the columns of FINDING, one row for each finding. Texts without any give no row.

    table has the patterns of provider keys in the columns of patterns.SCHEMA: the built-in ones if not given, or a caller's, or both (patterns.default_table).
    """
    return without_overlaps(all_findings(rows, table))


def detect_with_report(rows: DataFrame, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both results of one pass: the findings of detect_in_text, and (id, token, reason) as rejection_report has them.

    Every candidate is made and tried once; what comes of each item is one tagged row, written once in the shared folder, partitioned by its tag. The rejected part is
    diagnostic and carries raw tokens.
    """
    hit = F.bool_or("sound").alias("hit")
    told = by_item(looked_at(rows, "reported", patterns.compiled(table)), hit, F.first("token").alias("token"), F.first("reason").alias("reason"))
    finding = "transform(five, x -> named_struct('tag', 'finding', 'detector', x.detector, 'f', x.f, 'token', cast(null as string), 'reason', cast(null as string)))"
    rejected = "if(kind = 1 and not hit, array(named_struct('tag', 'rejected', 'detector', 4, 'f', null, 'token', token, 'reason', coalesce(reason, 'low-randomness'))), array())"
    tagged = told.select("id", "seq", F.explode(F.expr(f"concat({finding}, {rejected})")).alias("x"))
    both = stored(tagged.select("id", "seq", "x.tag", "x.detector", *[f"x.f.{c}" for c in FINDING], "x.token", "x.reason"), "report", "tag")
    return without_overlaps(both.filter("tag = 'finding'").drop("tag", "token", "reason")), both.filter("tag = 'rejected'").select("id", "token", "reason")


def rejection_report(rows: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(id, token, reason) of every candidate of 12 characters that is no provider key. Diagnostic: it carries raw tokens.

    Every candidate is made once. A candidate without a reason is low in randomness unless some prefix accepts it, which is tried beside it.
    """
    among = patterns.compiled(table)
    cands = candidates.explode(normalised(rows), "all", among).filter(f"length(token) >= {candidates.SHORTEST}").withColumn("reason", rejected_reason())
    told = tried(cands, "true", among).withColumn("hit", F.expr("reason is null and confidence is not null"))
    each = told.groupBy("id", "seq").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"), F.first("token").alias("token"), F.first("reason").alias("reason"))
    return each.filter("not hit").select("id", "token", F.coalesce("reason", F.lit("low-randomness")).alias("reason"))
