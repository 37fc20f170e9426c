"""The operators once more, a document at a time and in plain Python, for tests to hold the jobs against."""

import calendar
import datetime
import hashlib
import math
import re
from collections import Counter

from lyrebird.llm import pii, quality, urls

# Quality


def kept(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    if len(w) < 10 or 100 * len(covered) > 20 * len(w):
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    measures = {
        "mean_word_chars": sum(map(len, w)) / len(w), "symbol_ratio": sum(c in quality.SYMBOLS for c in text) / len(w),
        "stop_word_ratio": sum(x.rstrip(".,").lower() in quality.STOP_WORDS for x in w) / len(w), "dup_line_ratio": (len(lines) - len(set(lines))) / len(lines),
    }
    return all((r.least is None or measures[r.measure] >= r.least) and (r.most is None or measures[r.measure] <= r.most) for r in quality.RULES)


# Pseudonyms


def _digest(key, kind, r, x):
    return hashlib.sha256(f"{pii.subkey(key, kind)}|{r}|{x}".encode()).hexdigest()


def permuted(n, key, kind, size):
    a, b = divmod(n, size[1])
    for r in range(1, 9):
        a, b = b, (a + int(_digest(key, kind, r, b)[:14], 16)) % size[(r + 1) % 2]
    return a * size[1] + b


def characters(x, key, kind):
    def moved(half, by):
        out = ""
        for i, c in enumerate(half):
            d = int(by[i % 32 * 2 :][:2], 16)
            out += chr(97 + (ord(c) - 97 + d) % 26) if "a" <= c <= "z" else chr(48 + (ord(c) - 48 + d) % 10) if "0" <= c <= "9" else c
        return out

    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    for r in range(1, 9):
        a, b = b, moved(a, _digest(key, kind, r, b))
    return a + b


def _luhn(digits):
    d = [int(x) for x in digits][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def _filled(shape, digits):
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


DAY_0 = datetime.date(1800, 1, 1)
LATE = None


def _late():
    """All days after the twelfth of their month, in order."""
    global LATE
    if LATE is None:
        LATE = [datetime.date(y, m, d) for y in range(1800, 2200) for m in range(1, 13) for d in range(13, calendar.monthrange(y, m)[1] + 1)]
    return LATE


def _date(x, key):
    for f, late in (("%Y-%m-%d", False), ("%d/%m/%Y", False), ("%m/%d/%Y", True), ("%d.%m.%Y", False)):
        try:
            day = datetime.datetime.strptime(x, f).date()
        except ValueError:
            continue
        if not 1800 <= day.year < 2200:
            return None
        new = _late()[permuted(_late().index(day), key, "late date", (9, 9833))] if late else DAY_0 + datetime.timedelta(permuted((day - DAY_0).days, key, "date", (189, 773)))
        return new.strftime(f)


def pseudonym(x, kind, key):
    """The new value, or None if x isn't a valid one."""
    digits = re.sub("[^0-9]", "", x)
    if kind == "email":
        low = x.lower()
        end = low.rpartition(".")[2]
        return characters(low[: len(low) - len(end)], key, kind) + end
    if kind == "phone":
        return _filled(x, digits[:-10] + characters(digits[-10:], key, kind))
    if kind == "card":
        inner = digits[0] + characters(digits[1:-1], key, kind)
        return _filled(x, inner + str(-_luhn(inner + "0") % 10)) if _luhn(digits) % 10 == 0 else None
    if kind == "ssn":
        area, group, serial = int(x[:3]), int(x[4:6]), int(x[7:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        n = permuted((area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1, key, kind, (898, 99 * 9999))
        a, rest = divmod(n, 99 * 9999)
        return f"{a + 1 + (a >= 665):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    if kind == "ip":
        parts = [int(p) for p in x.split(".")]
        n = permuted(sum(p << 8 * (3 - i) for i, p in enumerate(parts)), key, kind, (65536, 65536)) if max(parts) < 256 else None
        return None if n is None else ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    return _date(x, key)


def pseudonyms(text, key):
    if text is None:
        return None

    def new(m):
        for kind, pattern in pii.PATTERNS.items():
            bare = pattern.split(")", 1)[1]
            if re.fullmatch(bare[: bare.rindex("(?!")], m[0], re.A):
                out = pseudonym(m[0], kind, key)
                return m[0] if out is None else out
        raise AssertionError(m[0])

    return re.sub(pii.ANY, new, text, flags=re.A)


# Mixing


def copies(docs, seed="mix"):
    """How often each of the rows (doc_id, source) comes, at the square roots of the sources' sizes."""
    n = Counter(s for _, s in docs)
    scale = len(docs) / sum(math.sqrt(k) for k in n.values())
    out = []
    for i, s in docs:
        rate = math.sqrt(n[s]) * scale / n[s]
        draws = max(1, math.ceil(rate / 16))
        total = 0
        for j in range(draws):
            u = int(hashlib.md5(f"{seed}|{i}|{s or ''}|{j}".encode()).hexdigest()[:13], 16) / 16**13
            k, p = 0, math.exp(-rate / draws)
            at = p
            while at <= u:
                k += 1
                p *= rate / draws / k
                at += p
            total += k
        out.append(total)
    return out


# Path templates


def _branches(segs):
    """The name of each of a node's segments and the number of pages that share it; segs: (segment, bad or None)."""
    counts = {}
    for seg, bad in segs:
        n = counts.setdefault(seg, [0, 0, 0])
        n[0], n[1], n[2] = n[0] + 1, n[1] + (bad is not None), n[2] + (bad or 0)
    own = {seg: seg if n[0] >= urls.LEAST_PAGES else "*" for seg, n in counts.items()}
    branches = {}
    for seg, n in counts.items():
        b = branches.setdefault(own[seg], [0, 0, 0])
        b[:] = [x + y for x, y in zip(b, n)]
    bins = {}
    for name, (n, labelled, bad) in branches.items():
        bins.setdefault(int(urls.RATES * bad / labelled) if labelled >= urls.LEAST_LABELS else -1, []).append(name)
    groups, last = [], None
    for b in sorted(bins):
        n, labelled, bad = (sum(branches[x][i] for x in bins[b]) for i in range(3))
        rate = (bad + 0.5) / (labelled + 1)
        if b >= 0 and last is not None:
            pooled = (bad + last[1] + 0.5) / (labelled + last[0] + 1)
            error = math.sqrt(pooled * (1 - pooled) * (1 / (labelled + 1) + 1 / (last[0] + 1)))
            if rate - last[2] <= urls.Z * error:
                groups[-1].extend(bins[b])
                last = labelled, bad, rate
                continue
        groups.append(list(bins[b]))
        last = (labelled, bad, rate) if b >= 0 else None
    out = {}
    for g in groups:
        name = g[0] if len(g) == 1 else "{" + min(g) + ("|" if len(g) == 2 else f"|+{len(g) - 2}|") + max(g) + "}"
        for x in g:
            out[x] = name, sum(branches[y][0] for y in g)
    return {seg: out[own[seg]] for seg in counts}


def templates(pages):
    """template, labels of its own and rate of each of the pages (host, path, bad or None)."""
    segs = [[x for x in path.split("/") if x] for _, path, _ in pages]
    found, going, level = [""] * len(pages), {i for i, x in enumerate(segs) if x}, 0
    while going:
        nodes = {}
        for i in going:
            seg = "*" if re.search(urls.VARIABLE, segs[i][level]) else segs[i][level]
            nodes.setdefault((pages[i][0], found[i]), []).append((i, seg))
        for members in nodes.values():
            names = _branches([(seg, pages[i][2]) for i, seg in members])
            for i, seg in members:
                name, n = names[seg]
                below = len(segs[i]) - level - 1
                on = below > 0 and n >= urls.LEAST_PAGES
                found[i] += "/" + name + ("" if on else "/*" * below)
                if not on:
                    going.discard(i)
        level += 1
    labelled, bad = Counter(), Counter()
    own, own_bad = Counter(), Counter()
    above = lambda t: ["/".join(t.split("/")[:k]) for k in range(1, max(2, len(t.split("/"))))]
    for t, (host, _, b) in zip(found, pages):
        own[host, t] += b is not None
        own_bad[host, t] += b or 0
        for node in {*above(t), t}:
            labelled[host, node] += b is not None
            bad[host, node] += b or 0
    prior = sum(b or 0 for _, _, b in pages) / (sum(b is not None for _, _, b in pages) + 2 * urls.WEIGHT)
    out = []
    for t, (host, _, _) in zip(found, pages):
        rate = prior
        for node in above(t):
            rate = (bad[host, node] + urls.WEIGHT * rate) / (labelled[host, node] + urls.WEIGHT)
        out.append((t, own[host, t], (own_bad[host, t] + urls.WEIGHT * rate) / (own[host, t] + urls.WEIGHT)))
    return out
