"""Brute-force forms of the operators, written without Spark."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs, items, span=10):
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        words = WORD.findall(lower(text or ""))
        if item_id is None or not words:
            continue
        n = min(span, len(words))
        for s in range(len(words) - n + 1):
            windows.setdefault(tuple(words[s:s + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lower(text or "")), set(), set()
        for n in {len(w) for w in windows}:
            for s in range(len(words) - n + 1):
                got = windows.get(tuple(words[s:s + n]))
                if got:
                    found |= got
                    hit |= set(range(s, s + n))
        out.append((doc_id, len(words), len(hit), len(found), sha(sorted(map(str, found))), bool(hit)))
    return out


def fingerprint(text) -> int:
    words = TOKEN.findall(lower(text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(prints, radius=2):
    """The index of the first fingerprint of each one's component."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def simhash(docs):
    prints = [fingerprint(t) for _, t in docs]
    root = roots(prints)
    first: dict[int, int] = {}
    for (doc_id, _), r in zip(docs, root):
        if doc_id is not None:
            first[r] = min(first.get(r, doc_id), doc_id)
    return [(d, f"{p:016x}", first.get(r)) for (d, _), p, r in zip(docs, prints, root)]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def strong_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def luhn(number):
    s = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        s += d - 9 if d > 9 else d
    return s % 10 == 0


def personal_data(text):
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m.group())
        if 16 <= len(number) <= 19 and luhn(number):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [f"{k}:{a}:{b}" for k, a, b in out]


def top_k(rows, k=10):
    ok = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in sorted(ok):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return out


def mix_targets(sizes):
    """Water filling by rounds: cap what passes three times its source, deal the excess by weight again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            capped.add(s)
            target[s] = float(3 * sizes[s])
            left -= 3 * sizes[s]


def count_tokens(text):
    return len(TOKEN.findall(text or ""))


def symbol(b):
    c = chr(b)
    if b >= 0x80:
        return 31
    if c in " \t\r\n\x0b\x0c":
        return 26
    if "a" <= c <= "z":
        return b - 97
    return 27 if "A" <= c <= "Z" else 28 if "0" <= c <= "9" else 29 if c in ".,;:?!'-" else 30


class KneserNey:
    """Interpolated modified Kneser-Ney over symbol classes, with dictionaries."""

    def __init__(self, texts, order=4):
        self.order, self.c = order, [None] * (order + 1)
        top: dict[tuple, int] = {}
        for t in texts:
            s = [26] * (order - 1) + [symbol(b) for b in (t or "").encode()]
            for i in range(order - 1, len(s)):
                g = tuple(s[i - order + 1:i + 1])
                top[g] = top.get(g, 0) + 1
        self.c[order] = top
        for k in range(order - 1, 0, -1):
            self.c[k] = {}
            for g in self.c[k + 1]:
                self.c[k][g[1:]] = self.c[k].get(g[1:], 0) + 1
        self.d, self.context = [None] * (order + 1), [None] * (order + 1)
        for k in range(1, order + 1):
            t = [0] + [sum(1 for n in self.c[k].values() if n == j) for j in (1, 2, 3, 4)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else 0.5
            self.d[k] = [0.0] + [max(0.05, min(j - 0.05, j - (j + 1) * y * t[j + 1] / t[j] if t[j] else 0.5 * j)) for j in (1, 2, 3)]
            held: dict[tuple, list] = {}
            for g, n in self.c[k].items():
                x = held.setdefault(g[:-1], [0, 0.0])
                x[0] += n
                x[1] += self.d[k][min(n, 3)]
            self.context[k] = held

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / 32
        below = self.p(g[1:])
        if g[:-1] not in self.context[k]:
            return below
        total, cut = self.context[k][g[:-1]]
        n = self.c[k].get(g, 0)
        return (n - self.d[k][min(n, 3)]) / total + cut / total * below if n else cut / total * below

    def perplexity(self, text):
        s = [26] * (self.order - 1) + [symbol(b) for b in (text or "").encode()]
        n = len(s) - self.order + 1
        if not n:
            return None
        return math.exp(-sum(math.log(self.p(tuple(s[i - self.order + 1:i + 1]))) for i in range(self.order - 1, len(s))) / n)


def with_repeats(doc_id, words):
    """The words of a document as the query on runs of words takes them."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def periodic_runs(words, least=6, periods=4):
    """(start, length, period) of all runs, from comparing each word with that q places later, for every q."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, periods * q):
                if not any(all(words[t] == words[t + p] for t in range(start, start + length - p)) for p in range(1, q)):
                    out.append((start, length, q))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_row(doc_id, text):
    words = with_repeats(doc_id, TOKEN.findall(text or ""))
    runs = periodic_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    digest = hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
    collapsed = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, collapsed)


def shingle_components(docs, k=4):
    """(doc_id, n_shingles, component_id, kept) from comparing the shingle sets of all pairs."""
    sets = []
    for _, text in docs:
        words = TOKEN.findall(lower(text or ""))
        sets.append(frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(find(i)), d is not None and d == least.get(find(i))) for i, (d, _) in enumerate(docs)]


def collocations(docs, least, top):
    """Rows of the leading phrases of (text, lang) pairs."""
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[s:s + k])) for k in range(1, 5) for s in range(len(words) - k + 1))
    frequent = {key: c for key, c in f.items() if c >= least}
    most = Counter()
    for (lang, p), c in frequent.items():
        for k in range(2, len(p)):
            for s in range(len(p) - k + 1):
                most[lang, p[s:s + k]] = max(most[lang, p[s:s + k]], c)
    rows = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and 100 * most[lang, p] < 80 * a:
            cuts = [(f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, (l, r) = min((2_000_000 * a // (l + r), k, (l, r)) for k, (l, r) in enumerate(cuts))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]


def linked_secrets(text: str | None, kinds: dict[str, str], roles: dict[str, str], scope: int, shortest: int) -> list[tuple[str, int, int]]:
    """Reported parts of a text of ASCII characters by comparing all pairs of its parts."""
    parts = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            if kind != "assign" or len(m.group(1)) >= shortest:
                parts.append((m.start(), list(kinds).index(kind), m.end(), kind))
    out = []
    for a, rank, b, kind in parts:
        near = {roles[k] for c, _, d, k in parts if abs(a - c) <= scope and (b <= c or d <= a)}
        enough = {"id": "secret" in near, "secret": bool({"id", "address"} & near), "address": {"id", "secret"} <= near}[roles[kind]]
        if kind in ("assign", "access", "hex") or enough:
            out.append((a, rank, b, kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]
