"""Plain versions that the operators are held against."""

import hashlib
import re
from collections import Counter

sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def luhn(d):
    t = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (1 + i % 2)
        t += n - 9 * (n > 9)
    return t % 10 == 0


def pii(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, z) for a, k, z in sorted(out)]


def quality(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(cover),
        "base_failed": len(w) < 10 or 100 * len(cover) > 20 * len(w),
    }


def shingles(text):
    w = SPACE_WORD.findall((text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(docs):
    """{doc: (n_shingles, component)} of {doc: text}."""
    sets = {d: shingles(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    tried = set()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        ra, rb = root(a), root(b)
                        up[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in docs}


def repeated_bytes(docs, m=200):
    """{doc: (n_bytes, n_removed, n_spans, kept_sha256)} of {doc: text}."""
    raw = {d: (t or "").encode() for d, t in docs.items()}
    n = Counter(b[i : i + m] for b in raw.values() for i in range(len(b) - m + 1))
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - m + 1):
            if n[b[i : i + m]] > 1:
                gone[i : i + m] = b"\1" * m
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def decontaminate(docs, items, width=10):
    """{doc: (n_words, n_hit, item ids)}."""
    words = lambda t: ALNUM_WORD.findall((t or "").translate(LOW))
    pats = {}
    for i, t in items.items():
        w = words(t)
        k = min(width, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            pats.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    out = {}
    for d, t in docs.items():
        w, hit, found = words(t), set(), set()
        for k in {len(p) for p in pats}:
            for s in range(len(w) - k + 1):
                if o := pats.get(tuple(w[s : s + k])):
                    found |= o
                    hit |= set(range(s, s + k))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def boilerplate(rows, ratio, smooth):
    """{(host, line)} of rows (host, text): lines on more than that ratio of a host's distinct texts, and so many more."""
    hosts, on = {}, {}
    for h, t in set(rows):
        hosts[h] = hosts.get(h, 0) + 1
        for x in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            on[h, x] = on.get((h, x), 0) + 1
    return {k for k, n in on.items() if n > ratio * (hosts[k[0]] + smooth)}


def battery(token, unevenness, stray, serial):
    """(chi, runs, serial) p-values of a string."""
    from math import erfc, sqrt

    low = lambda z: erfc(-z / sqrt(2)) / 2
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    if re.fullmatch("[0-9a-f]+=*|[0-9A-F]+=*", token):
        kind, abc, token = "hex", digits + "abcdef", token.lower()
    elif re.fullmatch("[A-Z2-7]+=*", token):
        kind, abc = "base32", upper + "234567"
    elif re.fullmatch("[A-Za-z0-9]+=*", token):
        kind, abc = "alnum", upper + lower + digits
    else:
        kind, abc = "base64", upper + lower + digits + "+/"
    uneven = unevenness[kind]
    body = re.sub("=+$", "", token.replace("-", "+").replace("_", "/"))
    x, n, k = [abc.find(c) for c in body], len(body), len(abc)
    if n < 2:
        return 1.0, 1.0, 1.0
    even = n / k
    chi2 = sum((body.count(c) - even) ** 2 / even for c in abc)
    chi = (chi2 - (k - 1) - uneven * n) / sqrt(2 * (k - 1) + 4 * uneven * n)
    up = [v >= k / 2 for v in x]
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    mean = 1 + 2 * sum(up) * (n - sum(up)) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    run = abs(runs - mean) / sqrt(var) - stray * sqrt(n) if var > 0 else 9.0
    m = sum(x) / n
    under = sum((v - m) ** 2 for v in x)
    corr = sum((a - m) * (b - m) for a, b in zip(x, x[1:])) / under if under else None
    ser = (abs(corr + 1 / n) - serial) * sqrt(n) if under else 9.0
    return low(chi), low(run), low(ser)


def weak_labels(votes, prior, on_good, on_bad, rounds):
    """Posterior of good for each row of votes, by EM over the rows with those made-up votes a row."""
    n, k = len(votes), len(votes[0])
    share = lambda a, b: a / (a + b)
    p, acc = share(*prior), [(share(*on_good), share(*on_bad))] * k

    def post():
        out = []
        for v in votes:
            g, b = p, 1 - p
            for x, (right_g, right_b) in zip(v, acc):
                if x:
                    g *= right_g if x > 0 else 1 - right_g
                    b *= 1 - right_b if x > 0 else right_b
            out.append(g / (g + b))
        return out

    for _ in range(rounds):
        q = post()
        p = (prior[0] * n + sum(q)) / (n + sum(prior) * n)
        acc = []
        for j in range(k):
            c = [(x, v[j]) for x, v in zip(q, votes)]
            g = share(on_good[0] * n + sum(x for x, v in c if v > 0), on_good[1] * n + sum(x for x, v in c if v < 0))
            b = share(on_bad[0] * n + sum(1 - x for x, v in c if v < 0), on_bad[1] * n + sum(1 - x for x, v in c if v > 0))
            acc.append((g, b))
    return post()
