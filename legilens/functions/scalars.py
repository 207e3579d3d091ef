"""Scalar functions over text: tolerance for misread characters, randomness, look-alikes of secrets, display and legibility.

Every function takes SQL expressions and a dialect and returns an SQL expression. Spark evaluates all of them in the
JVM. Lower case is that of ASCII letters throughout; lengths and places count code points.
"""

from __future__ import annotations

from legilens.functions.dialect import Dialect, re_quote
from legilens.functions import dictionaries as known

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(s: str, d: Dialect) -> str:
    return f"translate({s}, '{UPPER}', '{LOWER}')"


def any_of(s: str, words: tuple[str, ...], d: Dialect) -> str:
    """Whether s holds one of the words."""
    return d.matches(s, "|".join(re_quote(w) for w in words))


# Tolerance for misread characters


def normalize_unicode(s: str, d: Dialect) -> str:
    source = "".join(known.FOLDS.values())
    target = "".join(plain * len(odd) for plain, odd in known.FOLDS.items())
    return f"translate({s}, {d.lit(source + known.DELETED)}, {d.lit(target)})"


def classes() -> tuple[str, str]:
    source = "".join(known.CONFUSED.values())
    target = "".join(c * len(members) for c, members in known.CONFUSED.items())
    rest = "".join(c for c in UPPER if c not in source)
    return source + rest, target + rest.lower()


def confusion_class(s: str, d: Dialect) -> str:
    """Each character as the one that stands for its class; keeps the length."""
    source, target = classes()
    return f"translate({s}, {d.lit(source)}, {d.lit(target)})"


def normalize_confusable(s: str, d: Dialect) -> str:
    """Like confusion_class, after pairs that read as one letter were merged."""
    for pair, one in known.MERGED:
        s = f"replace({s}, '{pair}', '{one}')"
    return confusion_class(s, d)


def confusable_python(s: str) -> str:
    """normalize_confusable of a constant."""
    for pair, one in known.MERGED:
        s = s.replace(pair, one)
    return s.translate(str.maketrans(*classes()))


def find_all(s: str, needle: str, d: Dialect) -> str:
    """Places from 0 at which the constant needle occurs in s, both in confusion space; occurrences may overlap."""
    n = needle.translate(str.maketrans(*classes()))
    hay = confusion_class(s, d)
    place = d.filter(d.seq("1", f"length(h) - {len(n) - 1}"), "i", f"{d.sub('h', 'i', str(len(n)))} = {d.lit(n)}")
    found = d.transform(place, "i", "cast(i - 1 as int)")
    none = d.filter("array(0)" if d.text == "string" else "[0]", "i", "i > 0")
    return d.let("h", hay, f"case when contains(h, {d.lit(n)}) then {found} else {none} end")


def levenshtein_within(a: str, b: str, most: str, d: Dialect) -> str:
    distance = d.levenshtein(a, b)
    return f"case when {distance} <= {most} then {distance} end"


def fuzzy_prefix(s: str, prefix: str, most: int, d: Dialect) -> str:
    """Characters of s that stand for the constant prefix, null if none do.

    First characters must share a class. Of the beginnings up to most characters longer or shorter the nearest in confusion
    space counts, then the one nearest in length, then the shorter.
    """
    wanted, p = d.lit(confusable_python(prefix)), len(prefix)
    head = normalize_confusable(d.sub(s, "1", "n"), d)
    tries = d.transform(
        d.seq(str(max(1, p - most)), f"least({p + most}, length({s}))"), "n", d.struct(d=d.levenshtein(head, wanted), off=f"abs(n - {p})", n="cast(n as int)")
    )
    best = d.let("t", d.least_of(tries), f"case when t.d <= {most} then t.n end")
    first = f"{confusion_class(d.sub(s, '1', '1'), d)} = {d.lit(confusable_python(prefix[0]))}"
    return f"case when {first} then {best} end"


def charset_ratio(s: str, inside: str, d: Dialect) -> str:
    """Share of characters inside a character class, 0 for the empty text."""
    return f"(case when length({s}) = 0 then 0.0 else cast(length({d.without(s, f'[^{inside}]')}) as double) / length({s}) end)"


SECRET_CLASS = "A-Za-z0-9_+/=.-"


def secret_charset_ratio(s: str, d: Dialect) -> str:
    return charset_ratio(s, SECRET_CLASS, d)


# Randomness


def shannon(s: str, d: Dialect) -> str:
    """Bits for each character."""
    share = f"(cast(length({s}) - length(replace({s}, c, '')) as double) / length({s}))"
    return d.total(d.transform(d.distinct(d.chars(s)), "c", f"-{share} * log2({share})"))


def count_of(s: str, inside: str, d: Dialect) -> str:
    return f"cast(length({d.without(s, f'[^{inside}]')}) as {d.int})"


def composition(s: str, d: Dialect) -> dict[str, str]:
    """Counts of the characters of each class."""
    out = {name: count_of(s, inside, d) for name, inside in (("lower", "a-z"), ("upper", "A-Z"), ("digit", "0-9"), ("special", "_+/=.-"))}
    total = f"cast(length({s}) as {d.int})"
    return out | {"other": f"({total} - " + " - ".join(out.values()) + ")", "len": total}


def classes_present(s: str, d: Dialect) -> str:
    return "(" + " + ".join(f"cast({d.matches(s, f'[{c}]')} as int)" for c in ("a-z", "A-Z", "0-9", "_+/=.-")) + ")"


def is_wordlike(s: str, d: Dialect) -> str:
    """No digit, no special sign and at most one capital."""
    return f"(length({s}) > 0 and not {d.matches(s, '[0-9_+/=.-]')} and not {d.matches(s, '[A-Z][^A-Z]*[A-Z]')})"


def is_all_hex(s: str, d: Dialect) -> str:
    return d.matches(s, "^[0-9a-fA-F]+$")


def is_all_digits(s: str, d: Dialect) -> str:
    return d.matches(s, "^[0-9]+$")


def _longest(items: str, breaks: str, d: Dialect) -> str:
    """Longest stretch of a list c without a break, where breaks is a condition on places i > 1."""
    cuts = d.filter(d.seq("1", d.size("c")), "i", f"i = 1 or {breaks}")
    widths = d.transform(d.seq("1", d.size("b")), "k", f"coalesce({d.at('b', 'k + 1')}, {d.size('c')} + 1) - {d.at('b', 'k')}")
    return d.let("c", items, d.let("b", cuts, f"cast(coalesce({d.greatest_of(widths)}, 0) as int)"))


def longest_same_run(s: str, d: Dialect) -> str:
    return f"(case when length({s}) = 0 then 0 else " + _longest(d.chars(s), f"{d.at('c', 'i')} <> {d.at('c', 'i - 1')}", d) + " end)"


def longest_monotonic_run(s: str, d: Dialect) -> str:
    """Longest stretch in which code points rise, or fall, by one."""
    codes = d.transform(d.chars(s), "x", d.code("x"))
    up = _longest(codes, f"{d.at('c', 'i')} - {d.at('c', 'i - 1')} <> 1", d)
    down = _longest(codes, f"{d.at('c', 'i - 1')} - {d.at('c', 'i')} <> 1", d)
    return f"(case when length({s}) = 0 then 0 else greatest({up}, {down}) end)"


def distinct_ratio(s: str, d: Dialect) -> str:
    return f"(case when length({s}) = 0 then 0.0 else cast({d.size(d.distinct(d.chars(s)))} as double) / length({s}) end)"


def randomness(s: str, d: Dialect) -> str:
    """0 to 1: entropy, classes and distinct characters, less for runs and words; 0 below 8 characters."""
    entropy = f"least({shannon(s, d)} / least(log2(cast(length({s}) as double)), 6.0), 1.0)"
    n = classes_present(s, d)
    classes = f"(case {n} when 4 then 1.0 when 3 then 0.85 when 2 then 0.45 else 0.0 end)"
    distinct = f"least({distinct_ratio(s, d)} / 0.6, 1.0)"
    run = longest_same_run(s, d)
    penalty = d.let("r", run, "case when r >= 5 then 0.3 when r >= 4 then 0.7 else 1.0 end")
    word = f"(case when {is_wordlike(s, d)} then 0.35 else 1.0 end)"
    mixed = " + ".join(f"cast({w} as double) * cast({x} as double)" for w, x in (("0.45", entropy), ("0.35", classes), ("0.20", distinct)))
    return f"(case when length({s}) < 8 then cast(0 as double) else ({mixed}) * cast({penalty} as double) * cast({word} as double) end)"


# Look-alikes of secrets


def is_too_short(s: str, d: Dialect) -> str:
    return f"(length({s}) < 8)"


def is_placeholder(s: str, d: Dialect) -> str:
    framed = d.matches(s, r"(?s)^(<.*>|\{.*\}|\[.*\])$")
    masked = any_of(s, ("***", "•••", "…", "..."), d)
    marked = any_of(lower(s, d), known.PLACEHOLDERS, d)
    return f"({framed} or {masked} or {marked} or {longest_same_run(s, d)} >= 6 or {longest_monotonic_run(s, d)} >= 8)"


def is_documented(s: str, d: Dialect) -> str:
    return any_of(s, known.DOCUMENTED, d)


def is_data_uri(s: str, d: Dialect) -> str:
    return d.matches(lower(s, d), "^(data|blob):")


def is_mime(s: str, d: Dialect) -> str:
    low = lower(s, d)
    return f"({d.matches(low, '^(application/|text/|image/|multipart/|charset=)')} or {low} in ('gzip', 'deflate', 'br'))"


def is_integrity_hash(s: str, d: Dialect) -> str:
    return d.matches(lower(s, d), "^(sha512-|sha384-|sha256[-:]|sha1-|md5-)")


def is_uuid(s: str, d: Dialect) -> str:
    hexes = "[0-9a-fA-F]"
    return d.matches(s, rf"^({hexes}{{32}}|{hexes}{{8}}-{hexes}{{4}}-{hexes}{{4}}-{hexes}{{4}}-{hexes}{{12}})$")


def is_git_sha(s: str, d: Dialect) -> str:
    return d.matches(s, "^([0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{7,12})$")


def is_hashed_file(s: str, d: Dialect) -> str:
    return d.matches(lower(s, d), "(" + "|".join(re_quote(e) for e in known.HASHED_ENDINGS) + ")$")


def is_hex_color(s: str, d: Dialect) -> str:
    return d.matches(s, "^#([0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$")


def is_semver(s: str, d: Dialect) -> str:
    return d.matches(s, r"(?s)^[vV^~=><]*[0-9]+(\.[0-9]+){1,3}([-+].*)?$")


def is_ip(s: str, d: Dialect) -> str:
    part = "(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    v4 = d.matches(s, rf"(?s)^{part}(\.{part}){{3}}(:.*)?$")
    return f"({v4} or {d.matches(s, '^[0-9a-fA-F:]*$')} and {d.matches(s, ':.*:')})"


def is_timestamp(s: str, d: Dialect) -> str:
    return d.matches(s, r"^([0-9]{10}$|[0-9]{13}$|[0-9]{4}-[0-9]{2}-[0-9]{2})")


def is_file_path(s: str, d: Dialect) -> str:
    begins = d.matches(s, r"^(/|\./|\.\./|~/)")
    drive = f"length({s}) > 3 and {d.matches(s, '^[^:]?:')} and {d.sub(s, '2', '1')} = ':' and contains({s}, {d.lit(chr(92))})"
    return f"({begins} or ({drive}) or {any_of(s, ('/node_modules/', '/.git/'), d)})"


def is_plain_url(s: str, d: Dialect) -> str:
    """A web address without credentials in its authority."""
    low = lower(s, d)
    authority = d.extract(low, r"(?s)^[a-z]+://([^/]*)", 1)
    return f"({d.matches(low, '^(https?|wss?|ftp)://')} and not (contains({authority}, '@') and contains({authority}, ':')))"


def is_code_reference(s: str, d: Dialect) -> str:
    shell = f"{d.starts(s, d.lit('$'))} or ({d.starts(s, d.lit('%'))} and {d.ends(s, d.lit('%'))})"
    template = any_of(s, ("{{", "${", "(", ")"), d)
    dotted = d.matches(s, r"^[A-Za-z_-][A-Za-z0-9_-]*(\.[A-Za-z_-][A-Za-z0-9_-]*)+$")
    return f"({any_of(lower(s, d), known.ENV_ACCESS, d)} or {shell} or {template} or {dotted})"


#: Reasons in the order in which they are tried.
REJECTIONS = (
    ("too-short", is_too_short), ("placeholder", is_placeholder), ("documented-example", is_documented), ("data-uri", is_data_uri),
    ("mime-or-encoding", is_mime), ("integrity-hash", is_integrity_hash), ("uuid", is_uuid), ("git-sha", is_git_sha), ("content-hash-filename", is_hashed_file),
    ("hex-color", is_hex_color), ("semver", is_semver), ("ip-address", is_ip), ("timestamp", is_timestamp), ("file-path", is_file_path), ("plain-url", is_plain_url),
)


def structural_rejection(s: str, d: Dialect) -> str:
    """The first reason not to take s for a secret, null if there is none."""
    return "case " + " ".join(f"when {test(s, d)} then '{reason}'" for reason, test in REJECTIONS) + " end"


# Display


def mask(s: str, prefix: str, d: Dialect) -> str:
    """The prefix, 3 to 12 dots and the last two characters; dots only up to 4 characters."""
    head = f"least({prefix}, length({s}) - 3)"
    dots = f"greatest(least(length({s}) - {head} - 2, 12), 3)"
    return f"case when length({s}) <= 4 then {d.repeat(d.lit('•'), f'length({s})')} else concat({d.sub(s, '1', head)}, {d.repeat(d.lit('•'), dots)}, right({s}, 2)) end"


def format_timestamp(ms: str, d: Dialect) -> str:
    total = d.idiv(ms, "1000")
    h, m, s = d.idiv(total, "3600"), d.idiv(f"({total} % 3600)", "60"), f"({total} % 60)"
    two = lambda x: f"lpad(cast({x} as {d.text}), 2, '0')"
    return f"case when {h} > 0 then concat(cast({h} as {d.text}), ':', {two(m)}, ':', {two(s)}) else concat(cast({m} as {d.text}), ':', {two(s)}) end"


def format_visible_for(ms: str, d: Dialect) -> str:
    seconds = f"cast(floor({ms} / 1000.0 + 0.5) as {d.long})"
    m, s = d.idiv(seconds, "60"), f"({seconds} % 60)"
    t = lambda x: f"cast({x} as {d.text})"
    return (
        f"case when {ms} < 1000 then 'a single frame' when {seconds} < 60 then concat({t(seconds)}, ' second', case when {seconds} = 1 then '' else 's' end)"
        f" when {s} = 0 then concat({t(m)}, ' min') else concat({t(m)}, ' min ', {t(s)}, ' s') end"
    )


# Legibility of a recording


COMFORTABLE, MARGINAL = "15.0", "8.0"


def judge(px: str, d: Dialect) -> str:
    return f"case when {px} >= {COMFORTABLE} then 'comfortable' when {px} >= {MARGINAL} then 'marginal' else 'unreadable' end"


def glyph_before(font: str, scale: str, d: Dialect) -> str:
    return f"(greatest({font}, 0.0) * greatest({scale}, 0.0))"


def export_ratio(capture: str, export: str, d: Dialect) -> str:
    return f"(case when {capture} = 0 or {export} = 0 then cast(1 as double) else least(cast({export} as double) / {capture}, cast(1 as double)) end)"


def min_font_points(scale: str, d: Dialect) -> str:
    return f"case when {scale} > 0 and {scale} < cast('infinity' as double) then ceil(cast({COMFORTABLE} as double) / {scale} * 10) / 10.0 end"


def safe_export_height(font: str, scale: str, capture: str, d: Dialect) -> str:
    before = glyph_before(font, scale, d)
    return f"case when {before} >= {COMFORTABLE} and {capture} > 0 then cast(ceil({capture} * (cast({COMFORTABLE} as double) / {before})) as {d.long}) end"


# Small helpers


def is_video(path: str, d: Dialect) -> str:
    return d.matches(lower(path, d), r"\.(" + "|".join(known.VIDEO_ENDINGS) + ")$")


def fps_or_default(value: str, d: Dialect) -> str:
    n = d.number(value)
    return f"case when {n} > 0 and {n} < cast('infinity' as double) then {n} else cast(1 as double) end"


def is_obsolete_setting(key: str, d: Dialect) -> str:
    return d.matches(key, "^(" + "|".join(re_quote(p) for p in known.OBSOLETE_SETTINGS) + ")")


def shell_quote(s: str, d: Dialect) -> str:
    return f"concat('''', replace({s}, '''', {d.lit(chr(39) + chr(92) + chr(39) * 2)}), '''')" if d.text != "string" else f"concat(\"'\", replace({s}, \"'\", {d.lit(chr(39) + chr(92) + chr(39) * 2)}), \"'\")"


def save_location(raw: str, home: str, d: Dialect) -> str:
    """Folder of recordings: null is unknown (empty text), empty is the desktop, ~/ is the home; no slash at the end."""
    t = f"trim({raw})"
    there = f"case when {d.starts(t, d.lit('~/'))} then concat({home}, substring({t}, 2)) else {t} end"
    bare = f"regexp_replace({there}, '/+$', '')"
    return f"case when {raw} is null then '' when {t} = '' then concat({home}, '/Desktop') else {bare} end"


def shorten_home(path: str, d: Dialect) -> str:
    return f"case when {d.matches(path, '^/Users/[^/]+(/.*)?$')} then concat('~', {d.extract(path, '^/Users/[^/]+(/.*)?$', 1)}) else {path} end"


def display_phrase(width: str, height: str, scale: str, d: Dialect) -> str:
    """A display's size and scale as a person reads them; empty where the size is unknown (null or 0)."""
    t = lambda x: f"cast({x} as {d.text})"
    times = f"case when {scale} >= 2 then {t(f'cast(floor({scale} + 0.5) as {d.long})')} else '1' end"
    return f"case when coalesce({width}, 0) = 0 or coalesce({height}, 0) = 0 then '' else concat({t(width)}, ' × ', {t(height)}, ' at ', {times}, '×') end"


def initials(name: str, d: Dialect) -> str:
    words = d.filter(d.words(name), "w", "w <> ''")
    one = f"upper(substring({d.at('p', '1')}, 1, 2))"
    two = f"upper(concat(substring({d.at('p', '1')}, 1, 1), substring({d.last('p')}, 1, 1)))"
    return d.let("p", words, f"case when {d.size('p')} = 0 then 'ME' when {d.size('p')} = 1 then {one} else {two} end")
