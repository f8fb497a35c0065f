"""Plain single-machine versions of the operators, straight from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = "[^\\x20\\x09-\\x0D]+"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    text, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def secrets_base(text: str | None) -> list[tuple[str, int, int]]:
    text, spans = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m.group()) >= 16:
            spans.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m.group()) >= 32:
            spans.append((m.start(), 2, "hex", m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def edited(rows: list[tuple]) -> dict[int, str]:
    """doc_id -> edited text; doc_ids are distinct."""
    order = sorted(rows, key=lambda r: -r[0])
    found = {}
    for k, (doc, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        found[doc] = text[: len(text) - cut] + other[:cut]
    return found


def generalised_jaccard(a: str, b: str) -> float:
    x, y = (Counter(re.findall(SPACE, t.lower())) for t in (a, b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(SPACE, lower)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows: list[tuple], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest reachable doc_id), by comparing all sets that share a shingle."""
    sets = {doc: shingles(text, k) for doc, text in rows}
    up = {doc: doc for doc in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            holders[x].append(doc)
    shared: Counter = Counter()
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {doc: (len(s), root(doc)) for doc, s in sets.items()}


def targets(sizes: dict) -> dict:
    """source -> target, by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    whole, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        rest, total = whole - sum(fixed.values()), sum(weight[s] for s in open_)
        found = {s: rest * weight[s] / total for s in open_}
        above = [s for s in open_ if found[s] > 2 * sizes[s]]
        if not above:
            return fixed | found
        fixed |= {s: 2.0 * sizes[s] for s in above}


def dedup(rows: list[tuple], least: int = 10) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (lines, dropped lines, kept text)."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: lower(line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    found = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc]
        found[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return found
