"""Awkward tables and brute force."""

from __future__ import annotations

import collections
import math
import re

import regex

#: Nulls, empty and very long texts, ties, repeated rows.
LONG = "Very long words and words again. " * 4000
AWKWARD = [
    (1, "Hello there, this is a small text.", "en", "s", 34), (1, "Hello there, this is a small text.", "en", "s", 34), (2, None, None, None, None), (3, "", "en", "s", 0),
    (4, " \n\t ", "en", "s", 4), (5, LONG, "en", "s", len(LONG)), (6, "hello THERE, this is a small text.", "de", None, 1), (7, "Hello there,this is a small  text.", "en", "s", 1),
    (8, "a b", "en", "s", 3), (9, "A B", "en", "s", 3), (10, "12345 !!", "en", "s", 8), (11, "é́ \U0001F600 中文 x\x00y", "fr", "s", 9), (12, "x" * 50_000, "en", "s", 50_000),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = [
    "n", "set", "kind", "hash", "row_id", "run", "key", "score", "predicted", "kept", "root", "node", "start", "end", "check", "chars", "rep", "held_out", "x", "c", "words",
    "lost", "spans", "text_hash", "at", "base", "found", "slice", "digest", "__id", "__n", "__check", "__d_check", "__d_n", "__hash", "__spans", "__text_hash", "__lost", "a.b",
]


def awkward(spark, clash: bool = False):
    df = spark.createDataFrame(AWKWARD, COLUMNS).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return df


def no_rows(spark):
    return spark.createDataFrame([], COLUMNS)


def luhn(digits: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by Python's own regular expressions."""
    out = []
    for k, (name, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            v = m[0]
            d = re.sub("[^0-9]", "", v)
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), v))
    return sorted(out)


def all_spans(rows: list[tuple[int, str]], context: int = 60, support: int = 3, letters: int = 3) -> dict[int, str]:
    """Base and added spans of every document, by counting over all of them."""
    n, names = len(rows), [*BASE, "generalised", "removed"]
    base = {i: base_spans(t) for i, t in rows}
    seen, of_e, of_te, of_t = [], collections.defaultdict(set), collections.defaultdict(set), collections.Counter()
    for i, t in rows:
        of_t.update(set(regex.split(r"[^\p{L}]+", t.lower())))
        for k, p in enumerate(BASE.values()):
            found = list(p.finditer(t))
            good = {(s, e) for s, kk, e, _ in base[i] if kk == k}
            for j, m in enumerate(found):
                if (m.start(), m.end()) not in good:
                    continue
                v = m[0].lower() if k == 0 else m[0] if k == 1 else re.sub("[^0-9]", "", m[0])
                e = (k, v)
                of_e[e].add(i)
                lo, hi = found[j - 1].end() if j else 0, found[j + 1].start() if j + 1 < len(found) else len(t)
                for a, b, first, last in ((max(lo, m.start() - context), m.start(), m.start() - lo > context, False), (m.end(), min(hi, m.end() + context), False, hi - m.end() > context)):
                    parts, at = [], a
                    for w in regex.split(r"[^\p{L}]", t[a:b]):
                        parts.append((w, at))
                        at += len(w) + 1
                    for w, s in parts[first : len(parts) - last]:
                        if len(w) >= letters:
                            seen.append((i, e, w.lower(), s, s + len(w)))
                            of_te[e, w.lower()].add(i)
    out = {i: [x[:3] for x in b] for i, b in base.items()}
    more = {}
    for i, e, w, s, z in seen:
        both, one = len(of_te[e, w]), len(of_e[e])
        if both >= support and one < n:
            r = math.log(n * both / (of_t[w] * one)) / math.log(n / one)
            if r >= 0.8 - 1e-12:
                more[i, s, z] = max(more.get((i, s, z), 4), 5 if r >= 0.95 else 4)
    for (i, s, z), k in more.items():
        if not any(s < e and b < z for b, _, e, _ in base[i]):
            out[i].append((s, k, z))
    return {i: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(v)) for i, v in out.items()}


def links(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int]]:
    """(set size, smallest reachable id, links) of each document, from shingles as strings and an inverted index."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    post = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = collections.Counter()
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in post[x] if j > i)
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), n[i]) for i, s in sets.items()}
