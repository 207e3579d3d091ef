"""SQL of the findings in DuckDB's dialect: every candidate of every text, all detectors, overlaps and what is built on them.

Written without the automaton of the engine: all candidates are made, and each is tried but for those that read as words, which no built-in pattern accepts.
"""

from __future__ import annotations

from legilens.functions import dictionaries as known
from legilens.functions import scalars as f
from legilens.functions.dialect import Duck as D
from legilens.operators import candidates, incidents

WHITE_CLASS = known.WHITE.replace("\t-\r", r"\t-\r")
BOUNDARY = f"regexp_matches(c, '[{WHITE_CLASS}]') or contains({D.lit(known.BETWEEN)}, c)"


def folded(rows: str, ident: str) -> str:
    """(doc_id, text) of rows, characters folded."""
    return f"select {ident} as doc_id, {f.normalize_unicode('text', D)} as text from ({rows})"


def letters(rows: str) -> str:
    return f"select doc_id, unnest({D.chars('text')}) as c, generate_subscripts({D.chars('text')}, 1) - 1 as i from ({rows})"


def tokens(rows: str) -> str:
    """CTEs up to k: (doc_id, start, token)."""
    return f"""c as materialized ({letters(rows)}),
tb as (select *, {BOUNDARY} as gap from c),
tg as (select *, sum(gap::int) over (partition by doc_id order by i) as part from tb),
t as (select doc_id, min(i) as start, string_agg(c, '' order by i) as raw from tg where not gap group by doc_id, part),
k as materialized (select doc_id, start, regexp_replace(raw, '[.:,-]+$', '') as token from t)"""


SUFFIX = (
    "list_filter(list_transform(list_filter(generate_series(1, length(token)), lambda i: substring(token, i, 1) in ('=', ':')), lambda i: {'at': i, 'rest': substring(token, i + 1)}),"
    f" lambda x: length(x.rest) >= {candidates.SUFFIX} and regexp_matches(x.rest, '[^=]'))"
)


def fragments(rows: str, have_letters: bool = False) -> str:
    """CTEs up to j: (doc_id, start, end, token) of the runs."""
    c = "" if have_letters else f"c as materialized ({letters(rows)}),\n"
    return f"""{c}fb as (select *, not regexp_matches(c, '[A-Za-z0-9_.:/+=@-]') as gap from c),
fg as (select *, sum(gap::int) over (partition by doc_id order by i) as part from fb),
f as materialized (select doc_id, min(i) as s, max(i) + 1 as e, string_agg(c, '' order by i) as t from fg where not gap group by doc_id, part),
n as (select f.*, f.s - lag(f.e) over (partition by f.doc_id order by f.s) = 1 and coalesce(p.c = ' ', false) as glue, row_number() over (partition by f.doc_id order by f.s) as k
      from f left join c p on p.doc_id = f.doc_id and p.i = f.s - 1),
r as materialized (select *, sum(case when glue then 0 else 1 end) over (partition by doc_id order by k) as run from n),
x as (select a.doc_id, a.s, b.e, b.k - a.k as more, a.k as ka, b.k as kb from r a join r b on a.doc_id = b.doc_id and a.run = b.run and b.k > a.k and b.k - a.k < {candidates.SPAN}),
j as materialized (select x.doc_id, x.s as start, x.e as "end", string_agg(r.t, '' order by r.k) as token from x join r on r.doc_id = x.doc_id and r.k between x.ka and x.kb group by all)"""


PREFIXES = "(values " + ", ".join(
    f"({k}, {j}, '{p.id}', '{p.label}', '{p.provider}', '{p.severity}', {known.SEVERITIES.index(p.severity)}, {D.lit(prefix)}, {D.lit(f.confusable_python(prefix))},"
    f" {D.lit(f.confusable_python(prefix[0]))}, {len(prefix)}, {p.tolerance}, {p.body_min}, {p.body_max}, '[^{known.CHARSETS[p.charset]}]', {p.min_randomness}::double, {max(map(len, p.prefixes))})"
    for k, p in enumerate(known.PATTERNS)
    for j, prefix in enumerate(p.prefixes)
) + ") p(pattern_ord, prefix_ord, pattern_id, label, provider, severity, severity_rank, prefix, folded, anchor, prefix_len, tol, body_min, body_max, outside, least, longest)"


#: Columns of PREFIXES.
PREFIX_COLUMNS = (
    "pattern_ord, prefix_ord, pattern_id, label, provider, severity, severity_rank, prefix, folded, anchor, prefix_len, tol, body_min, body_max, outside, least, longest"
)


def matched(source: str, keys: str, prefixes: str = PREFIXES) -> str:
    """CTEs from ma to m: each row of source (keys, token) with its best prefix for each pattern that accepts it."""
    head = f.normalize_confusable("substring(token, 1, n)", D)
    return f"""ma as (select s.*, p.*, list_min(list_transform(generate_series(greatest(1, prefix_len - tol), least(prefix_len + tol, length(token))), lambda n:
      {{'d': {D.levenshtein(head, 'folded')}, 'off': abs(n - prefix_len), 'n': n}})) as best
      from {source} s join {prefixes} on {f.confusion_class('substring(token, 1, 1)', D)} = anchor),
mb as (select *, substring(token, best.n + 1) as body from ma where best.d <= tol),
mc as (select *, length(regexp_replace(body, outside, '', 'g'))::double / length(body) as ratio from mb where length(body) between body_min and body_max),
md as (select *, {f.randomness('body', D)} as random from mc where ratio >= 0.85),
me as (select *, least(1.0, 0.45 * case when starts_with(token, prefix) then 1.0 else 0.75 end + 0.30 * ratio + 0.25 * random) as confidence from md where random >= least),
m as materialized (select {keys}, token, pattern_ord, pattern_id, label, provider, severity, severity_rank, longest, best.n as consumed, confidence from me
      qualify row_number() over (partition by {keys}, pattern_ord order by confidence desc, prefix_ord) = 1)"""


BETTER = "lambda b, x: case when x.confidence > b.confidence + 0.05 or (x.longest > b.longest and x.confidence + 0.05 >= b.confidence) then x else b end"


def _one(**v: str) -> str:
    names = ("pattern_id", "label", "provider", "severity", "severity_rank", "start", "end", "preview", "confidence", "token_len")
    kinds = {"severity_rank": "integer", "start": "integer", "end": "integer", "confidence": "double", "token_len": "integer"}
    v["severity_rank"] = v.get("severity_rank") or str(known.SEVERITIES.index(v["severity"].strip("'")))
    return ", ".join(f"({v[n]})::{kinds.get(n, 'varchar')} as \"{n}\"" for n in names)


def every(rows: str, ident: str, prefixes: str = PREFIXES) -> str:
    """CTEs up to found: (doc_id, detector, seq list, columns of a finding), overlaps included."""
    text = folded(rows, ident)
    pem = " union all ".join(
        f"select doc_id, 0 as detector, [{k}, start, start + {len(h)}, 0] as seq, "
        + _one(pattern_id="'private_key'", label="'Private key'", provider="'PEM'", severity="'critical'", start="start", end=f"start + {len(h)}", preview="'-----BEGIN •••••• PRIVATE KEY-----'", confidence="0.98", token_len=str(len(h)))
        + f" from (select doc_id, unnest({f.find_all('text', h, D)}) as start from ft)"
        for k, h in enumerate(known.PEM_HEADERS)
    )
    low, place = f.lower("token", D), {"start": "start", "end": "\"end\"", "token_len": "length(token)"}
    scheme = "regexp_extract(" + low + ", '^(" + "|".join(f.re_quote(s) for s in known.SCHEMES) + ")')"
    part = f"length(p) >= 8 and {f.charset_ratio('p', known.CHARSETS['base64url'], D)} >= 0.9"
    key = "doc_id, seq, start, \"end\""
    return f"""ft as materialized ({text}),
{tokens('select * from ft')},
{fragments('', True)},
tc as materialized (select doc_id, [0, start, start + length(token), 0] as seq, start, start + length(token) as "end", token from k where token <> ''
  union all select doc_id, [0, start, start + length(token), x.at], start + x.at, start + x.at + length(x.rest), x.rest from (select doc_id, start, token, unnest({SUFFIX}) as x from k)
  union all select doc_id, [1, start, "end", 0], start, "end", token from j
  union all select doc_id, [1, start, "end", x.at], least(start + x.at, "end"), "end", x.rest from (select doc_id, start, "end", unnest({SUFFIX}) as x from j)),
ud as (select *, {scheme} as scheme from tc where contains(token, '://')),
ua as (select *, split_part(substring(token, length(scheme) + 1), '@', 1) as authority from ud where scheme <> '' and contains(substring(token, length(scheme) + 1), '@')),
up as (select *, substring(authority, strpos(authority, ':') + 1) as password from ua where contains(authority, ':')),
wt as (select *, {D.split('token', '.')} as parts from tc where starts_with(token, 'eyJ')),
sl as (select doc_id, unnest({D.split('text', chr(10))}) as line, generate_subscripts({D.split('text', chr(10))}, 1) as no from ft),
sa as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by no rows between unbounded preceding and 1 preceding), 0) as at_line from sl),
kw as (select unnest([{', '.join(D.lit(x) for x in known.KEYWORDS)}]) as kw, unnest(range({len(known.KEYWORDS)})) as kno),
h0 as (select sa.*, kw, kno, strpos({f.lower('line', D)}, kw) as hit from sa join kw on contains({f.lower('line', D)}, kw)),
h1 as (select *, substring(line, hit + length(kw)) as after from h0),
h2 as (select *, regexp_replace(after, '^[{WHITE_CLASS}]+', '') as trimmed from h1),
h3 as (select *, kw in ({', '.join(D.lit(x) for x in known.SPACED)}) and length(after) > length(trimmed) as spaced from h2 where trimmed <> ''),
h4 as (select *, regexp_replace(case when spaced then trimmed else substring(trimmed, 2) end, '^[{WHITE_CLASS}]+', '') as quoted from h3 where substring(trimmed, 1, 1) in ('=', ':') or spaced),
h5 as (select *, regexp_replace(regexp_extract(trim(quoted, {D.lit('"' + chr(39) + '`')}), '[^{WHITE_CLASS}]+'), {D.lit('[;,.)"' + chr(39) + '`]+$')}, '') as token, (at_line + length(line) - length(quoted))::integer as start from h4),
h6 as (select *, {f.randomness('token', D)} as random from h5 where length(token) >= 8 and ({f.structural_rejection('token', D)}) is null and not {f.is_code_reference('token', D)}
  and {f.secret_charset_ratio('token', D)} >= 0.85 and not {f.is_wordlike('token', D)}),
h7 as (select * from h6 where random >= 0.5 qualify row_number() over (partition by doc_id, no order by kno) = 1),
long as materialized (select {key}, token from tc where length(token) >= {candidates.SHORTEST} and regexp_matches(substring(token, 3), '[0-9_+/=.-]|[A-Z].*[A-Z]')),
{matched('long', key, prefixes)},
sound as (select * from m where ({f.structural_rejection('token', D)}) is null),
best as (select {key}, token, list_reduce(list({{'consumed': consumed, 'pattern_id': pattern_id, 'label': label, 'provider': provider, 'severity': severity, 'severity_rank': severity_rank, 'longest': longest,
  'confidence': confidence}} order by pattern_ord), {BETTER}) as b from sound group by all),
found as materialized ({pem}
  union all select doc_id, 1, seq, {_one(pattern_id="'db_uri'", label="'Connection string with password'", provider="replace(scheme, '://', '')", severity="'critical'", preview="concat(scheme, '•••••••@…')", confidence="0.92", **place)} from up where length(password) >= 4 and not {f.is_placeholder('password', D)}
  union all select doc_id, 2, seq, {_one(pattern_id="'jwt'", label="'JSON Web Token'", provider="'JWT'", severity="'high'", preview=f.mask('token', '6', D), confidence="0.88", **place)} from wt where len(parts) = 3 and len(list_filter(parts, lambda p: not ({part}))) = 0 and not {f.is_placeholder('token', D)}
  union all select doc_id, 3, [0, at_line::bigint, at_line::bigint + length(line), 0], {_one(pattern_id="'assignment'", label="concat('Assigned secret (', kw, ')')", provider="'Generic'", severity="'high'", preview=f.mask('token', '2', D), confidence="least(1.0, 0.55 + 0.45 * random)", start="start", end="start + length(token)", token_len="length(token)")} from h7
  union all select doc_id, 4, seq, {_one(pattern_id="b.pattern_id", label="b.label", provider="b.provider", severity="b.severity", severity_rank="b.severity_rank", preview=f.mask('token', 'b.consumed', D), confidence="b.confidence", **place)} from best)"""


COLUMNS = "pattern_id, label, provider, severity, severity_rank, start, \"end\", preview, confidence, token_len"


def kept(rows: str, ident: str, prefixes: str = PREFIXES) -> str:
    """CTEs up to kept: the findings without overlaps."""
    fields = ", ".join(f"'{c.strip(chr(34))}': {c}" for c in COLUMNS.split(", "))
    return f"""{every(rows, ident, prefixes)},
listed as (select doc_id, list({{{fields}}} order by severity_rank desc, round(confidence, 9) desc, start, detector, seq) as a from found group by doc_id),
folded_up as (select doc_id, list_reduce(list_transform(a, lambda x: [x]), lambda k, x: case when len(list_filter(k, lambda y: x[1].start < y."end" and y.start < x[1]."end")) > 0 then k else list_concat(k, x) end) as a from listed),
kept as materialized (select doc_id, u.* from (select doc_id, unnest(a) as u from folded_up))"""


SHOWN = COLUMNS.replace("confidence", "round(confidence, 6) as confidence")


def documents(rows: str, ident: str, source: str, where: str = "true", name: str = "doc_id") -> str:
    """All findings (source found) or those without overlaps (source kept)."""
    ctes = kept(rows, ident) if source == "kept" else every(rows, ident)
    detector = "" if source == "kept" else "detector, "
    return f"with {ctes} select doc_id as {name}, {detector}{SHOWN} from {source} where {where}"


def frames(carried: str) -> str:
    """CTEs up to inc: findings of frames (carried: recording_id, frame_index, timestamp_ms, text) and their incidents."""
    keys = ", ".join(incidents.KEY)
    order = f"over (partition by {keys} order by timestamp_ms)"
    return f"""fr as materialized ({carried}),
{kept("select distinct sha256(text) as h, text from fr", "h")},
ff as materialized (select fr.recording_id, fr.frame_index, fr.timestamp_ms, kept.* exclude (doc_id) from fr join kept on sha256(fr.text) = kept.doc_id),
g1 as (select *, case when timestamp_ms - lag(timestamp_ms) {order} > {incidents.MERGE_GAP_MS} or lag(timestamp_ms) {order} is null then 1 else 0 end as fresh from ff),
g2 as (select *, sum(fresh) over (partition by {keys} order by timestamp_ms rows between unbounded preceding and current row) as session from g1),
inc as materialized (select {keys}, arg_min(label, (timestamp_ms, frame_index, start)) as label, arg_min(provider, (timestamp_ms, frame_index, start)) as provider,
  arg_min(severity, (timestamp_ms, frame_index, start)) as severity, arg_min(severity_rank, (timestamp_ms, frame_index, start)) as severity_rank,
  min(timestamp_ms) as first_seen_ms, max(timestamp_ms) as last_seen_ms, arg_min(frame_index, (timestamp_ms, frame_index)) as first_frame_index, count(*) as frame_count,
  round(max(confidence), 6) as confidence, max(timestamp_ms) - min(timestamp_ms) as duration_ms from g2 group by {keys}, session)"""
