"""A plain, slow version of the detectors in Python, written from the rules, for comparison."""

import math
import re

from legilens.functions import dictionaries as known

CLASS = {c: k for k, members in known.CONFUSED.items() for c in members}
SPACES = set("\t\n\v\f\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def fold(s):
    table = {odd: plain for plain, odds in known.FOLDS.items() for odd in odds}
    return "".join(table.get(c, c) for c in s if c not in known.DELETED)


def cls(c):
    return CLASS.get(c, low(c))


def conf(s):
    for a, b in known.MERGED:
        s = s.replace(a, b)
    return "".join(map(cls, s))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(s, inside):
    return len(re.findall(f"[{inside}]", s)) / len(s) if s else 0.0


def longest(s, same):
    best = run = 1 if s else 0
    for a, b in zip(s, s[1:]):
        run = run + 1 if same(a, b) else 1
        best = max(best, run)
    return best


def wordlike(s):
    return bool(s) and not re.search("[0-9_+/=.-]", s) and len(re.findall("[A-Z]", s)) <= 1


def randomness(s):
    n = len(s)
    if n < 8:
        return 0.0
    h = -sum(s.count(c) / n * math.log2(s.count(c) / n) for c in set(s))
    k = sum(bool(re.search(f"[{c}]", s)) for c in ("a-z", "A-Z", "0-9", "_+/=.-"))
    run = longest(s, lambda a, b: a == b)
    base = 0.45 * min(1, h / min(math.log2(n), 6)) + 0.35 * (0, 0, 0.45, 0.85, 1)[k] + 0.2 * min(1, len(set(s)) / n / 0.6)
    return base * (0.3 if run >= 5 else 0.7 if run >= 4 else 1) * (0.35 if wordlike(s) else 1)


def placeholder(s):
    t = low(s)
    if any(len(t) > 1 and t[0] == a and t[-1] == b for a, b in ("<>", "{}", "[]")):
        return True
    if any(x in s for x in ("***", "•••", "…", "...")) or any(m in t for m in known.PLACEHOLDERS):
        return True
    up, down = longest(s, lambda a, b: ord(b) - ord(a) == 1), longest(s, lambda a, b: ord(a) - ord(b) == 1)
    return longest(s, lambda a, b: a == b) >= 6 or max(up, down) >= 8


def reject(s):
    t = low(s)
    if len(s) < 8:
        return "too-short"
    if placeholder(s):
        return "placeholder"
    if any(x in s for x in known.DOCUMENTED):
        return "documented-example"
    if t.startswith(("data:", "blob:")):
        return "data-uri"
    if t.startswith(("application/", "text/", "image/", "multipart/", "charset=")) or t in ("gzip", "deflate", "br"):
        return "mime-or-encoding"
    if t.startswith(("sha512-", "sha384-", "sha256-", "sha256:", "sha1-", "md5-")):
        return "integrity-hash"
    parts = s.split("-")
    if re.fullmatch("[0-9a-fA-F]{32}", s.replace("-", "")) and ([len(p) for p in parts] == [8, 4, 4, 4, 12] or len(parts) == 1):
        return "uuid"
    if re.fullmatch("[0-9a-f]+", s) and (len(s) in (40, 64) or 7 <= len(s) <= 12):
        return "git-sha"
    if t.endswith(known.HASHED_ENDINGS):
        return "content-hash-filename"
    if s[0] == "#" and re.fullmatch("[0-9a-fA-F]+", s[1:]) and len(s) - 1 in (3, 4, 6, 8):
        return "hex-color"
    core = re.split("[-+]", s.lstrip("vV^~=><"))[0].split(".")
    if 2 <= len(core) <= 4 and all(re.fullmatch("[0-9]+", p) for p in core):
        return "semver"
    host = s.split(":")[0].split(".")
    if len(host) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in host):
        return "ip-address"
    if s.count(":") >= 2 and re.fullmatch("[0-9a-fA-F:]+", s):
        return "ip-address"
    if re.fullmatch("[0-9]{10}|[0-9]{13}", s) or re.match("[0-9]{4}-[0-9]{2}-[0-9]{2}", s):
        return "timestamp"
    if s.startswith(("/", "./", "../", "~/")) or (len(s) > 3 and s[1] == ":" and "\\" in s) or "/node_modules/" in s or "/.git/" in s:
        return "file-path"
    if t.startswith(("http://", "https://", "ws://", "wss://", "ftp://")):
        authority = t.split("//")[1].split("/")[0]
        return None if "@" in authority and ":" in authority else "plain-url"
    return None


def code_reference(s):
    if any(e in low(s) for e in known.ENV_ACCESS) or s.startswith("$") or (s.startswith("%") and s.endswith("%")):
        return True
    if any(x in s for x in ("{{", "${", "(", ")")):
        return True
    return "." in s and all(re.fullmatch("[A-Za-z_-][A-Za-z0-9_-]*", p) for p in s.split("."))


def mask(s, k):
    if len(s) <= 4:
        return "•" * len(s)
    head = min(k, len(s) - 3)
    return s[:head] + "•" * max(3, min(12, len(s) - head - 2)) + s[-2:]


def tokens(text):
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] not in SPACES and text[end] not in known.BETWEEN:
            end += 1
        t = text[at:end]
        while t and t[-1] in ".:,-":
            t = t[:-1]
        if t:
            yield at, at + len(t), t
        at = end + 1


def suffixes(t):
    return [(i + 1, t[i + 1 :]) for i, c in enumerate(t) if c in "=:" and len(t[i + 1 :]) >= 12 and set(t[i + 1 :]) != {"="}]


def glued(text):
    offset = 0
    for line in text.split("\n"):
        places, at = [], 0
        while at < len(line):
            end = at
            while end < len(line) and re.match("[A-Za-z0-9_.:/+=@-]", line[end]):
                end += 1
            if end > at:
                places.append((at, end))
            at = max(end, at + 1)
        for a in range(len(places)):
            for b in range(a + 1, min(a + 6, len(places))):
                if any(line[places[k][1] : places[k + 1][0]] != " " for k in range(a, b)):
                    break
                yield offset + places[a][0], offset + places[b][1], "".join(line[s:e] for s, e in places[a : b + 1])
        offset += len(line) + 1


def candidates(text):
    out = []
    for s, e, t in tokens(text):
        out.append((s, e, t))
        out += [(s + i, s + i + len(r), r) for i, r in suffixes(t)]
    for s, e, t in glued(text):
        out.append((s, e, t))
        out += [(min(s + i, e), e, r) for i, r in suffixes(t)]
    return out


def consumed(t, prefix, k):
    if not t or cls(t[0]) != cls(prefix[0]):
        return None
    p, best = len(prefix), None
    for n in range(max(1, p - k), min(p + k, len(t)) + 1):
        d = distance(conf(t[:n]), conf(prefix))
        if d <= k and (best is None or (d, abs(n - p)) < best[:2]):
            best = (d, abs(n - p), n)
    return best and best[2]


def match(t, p):
    best = None
    for prefix in p.prefixes:
        n = consumed(t, prefix, p.tolerance)
        if n is None:
            continue
        body = t[n:]
        r = ratio(body, known.CHARSETS[p.charset])
        if not p.body_min <= len(body) <= p.body_max or r < 0.85 or (rand := randomness(body)) < p.min_randomness:
            continue
        c = min(1.0, 0.45 * (1 if t.startswith(prefix) else 0.75) + 0.3 * r + 0.25 * rand)
        if best is None or c > best[0]:
            best = (c, n)
    return best


def provider(t):
    best = None
    for p in known.PATTERNS:
        m = match(t, p)
        if m and (best is None or m[0] > best[0] + 0.05 or (max(map(len, p.prefixes)) > max(map(len, best[2].prefixes)) and m[0] + 0.05 >= best[0])):
            best = (*m, p)
    return best


def assigned(text):
    offset = 0
    for line in text.split("\n"):
        for kw in known.KEYWORDS:
            at = low(line).find(kw)
            if at < 0:
                continue
            rest = line[at + len(kw) :]
            place = 0
            while place < len(rest) and rest[place] in SPACES:
                place += 1
            if place == len(rest):
                continue
            spaced = kw in known.SPACED and place > 0
            if rest[place] not in "=:" and not spaced:
                continue
            start = place if spaced else place + 1
            while start < len(rest) and rest[start] in SPACES:
                start += 1
            value = rest[start:].strip("\"'`")
            words = [w for w in re.split("[" + re.escape("".join(SPACES)) + "]+", value) if w]
            value = (words[0] if words else "").rstrip(";,.)\"'`")
            if len(value) < 8 or reject(value) or code_reference(value) or ratio(value, "A-Za-z0-9_+/=.-") < 0.85 or wordlike(value):
                continue
            r = randomness(value)
            if r < 0.5:
                continue
            s = offset + at + len(kw) + start
            yield ("assignment", 2, s, s + len(value), mask(value, 2), min(1.0, 0.55 + 0.45 * r), len(value))
            break
        offset += len(line) + 1


def detect(raw):
    text = fold(raw or "")
    out = []
    folded = "".join(map(cls, text))
    for h in known.PEM_HEADERS:
        want = "".join(map(cls, h))
        out += [("private_key", 3, i, i + len(h), "-----BEGIN •••••• PRIVATE KEY-----", 0.98, len(h)) for i in range(len(folded)) if folded.startswith(want, i)]
    cands = candidates(text)
    for s, e, t in cands:
        scheme = next((x for x in known.SCHEMES if low(t).startswith(x)), None)
        if scheme:
            rest = t[len(scheme) :]
            if "@" in rest and ":" in (auth := rest.split("@")[0]):
                password = auth.split(":", 1)[1]
                if len(password) >= 4 and not placeholder(password):
                    out.append(("db_uri", 3, s, e, scheme + "•••••••@…", 0.92, len(t)))
    for s, e, t in cands:
        parts = t.split(".")
        if t.startswith("eyJ") and len(parts) == 3 and all(len(p) >= 8 and ratio(p, "A-Za-z0-9_-") >= 0.9 for p in parts) and not placeholder(t):
            out.append(("jwt", 2, s, e, mask(t, 6), 0.88, len(t)))
    out += list(assigned(text))
    for s, e, t in cands:
        if len(t) >= 12 and not reject(t) and (m := provider(t)):
            c, n, p = m
            out.append((p.id, known.SEVERITIES.index(p.severity), s, e, mask(t, n), c, len(t)))
    kept = []
    for f in sorted(out, key=lambda f: (-f[1], -round(f[5], 9), f[2])):
        if not any(f[2] < k[3] and k[2] < f[3] for k in kept):
            kept.append(f)
    return sorted(((f[0], f[2], f[3], f[4], round(f[5], 6), f[6]) for f in kept), key=lambda f: f[1])


def report(raw):
    out = []
    for _, _, t in candidates(fold(raw or "")):
        if len(t) >= 12:
            r = reject(t) or (None if provider(t) else "low-randomness")
            if r:
                out.append((t, r))
    return sorted(out)
