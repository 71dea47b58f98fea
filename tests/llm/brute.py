"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def component_of(ids, links) -> dict:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(rows: dict[int, str | None], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, k) for i, t in rows.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = defaultdict(int)
    for held in holders.values():
        for n, a in enumerate(held):
            for b in held[n + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    component = component_of(rows, links)
    return {i: (len(sets[i]), component[i]) for i in rows}


def substring_dedup(rows: dict[int, str | None], k: int) -> dict[int, tuple[int, int, str]]:
    first, words = {}, {i: WORD.findall(t or "") for i, t in rows.items()}
    out = {}
    for i in sorted(words):
        own, gone = words[i], set()
        for s in range(len(own) - k + 1):
            w = tuple(own[s : s + k])
            if w in first:
                gone.update(range(s, s + k))
            else:
                first[w] = (i, s)
        kept = " ".join(x for n, x in enumerate(own) if n not in gone)
        out[i] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def crc(text: str) -> int:
    return zlib.crc32(text.encode())


def conversations_of(rows) -> dict:
    """Turns (turn, role, text) of each conversation, nulls first."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text))
    return {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or "")) for c, t in out.items()}


def cheapest_repair(turns: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """Tries every edit of every turn, and up to two inserts before each and at the end, none dearer than to delete all. ``turns``: role, text, fault."""
    best = (2 * len(turns), "D" * len(turns), [])
    shape, begun = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")

    def go(i, cost, audit, out, inserts):
        nonlocal best
        initials = "".join(x.split(":", 1)[0][:1] for x in out)
        if cost > best[0] or not begun.fullmatch(initials):
            return
        if i == len(turns) and shape.fullmatch(initials) and (cost, audit) < best[:2]:
            best = (cost, audit, list(out))
        if inserts < 2:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, f"{role}:"], inserts + 1)
        if i == len(turns):
            return
        role, text, fault = turns[i]
        go(i + 1, cost + 2, audit + "D", out, 0)
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a"):
                go(i + 1, cost + more, audit + "K", [*out, f"{role}:{text}"], 0)
            for new in ("user", "assistant"):
                go(i + 1, cost + more + 1, audit + "R", [*out, f"{new}:{text}"], 0)

    go(0, 0, "", [], 0)
    return best


def structure_repair(rows) -> dict:
    out = {}
    for conv, turns in conversations_of(rows).items():
        left = []
        for turn, role, text in turns:
            role, text = (" " if x is None else x for x in (role, text))
            fate = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            left += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
        seen, faults = set(), []
        for _, role, text in left:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [t for t, _, _ in left if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False))
        cost, audit, told = cheapest_repair([(r, t, f) for (_, r, t), f in zip(left, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def prefix_trie(rows) -> set:
    own = {c: [(r or "", t or "") for _, r, t in turns] for c, turns in conversations_of(r for r in rows if r[0] is not None).items()}
    rebuilt = {c: own.get(c - c % 20, [])[: crc(str(c)) % 4] + turns[crc(str(c)) % 4 :] for c, turns in own.items()}
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = set()
    for node, convs in members.items():
        below = [k for k in members if k[: len(node)] == node]
        children = [k for k in below if len(k) == len(node) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        saved = sum((len(members[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(node))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out
