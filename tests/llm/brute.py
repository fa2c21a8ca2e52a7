"""Plain versions of the operators, to hold results against."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def repeats(texts: list[bytes], length: int) -> list[tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans, kept of each text."""
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, x in zip(t, gone, strict=True) if not x)))
    return out


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int]]:
    """class_id, n_links, n_copies of each id, by comparing all sets that share a shingle."""
    holders: dict[frozenset, list[int]] = {}
    out = {}
    for i, t in rows:
        if s := shingles(t):
            holders.setdefault(s, []).append(i)
        else:
            out[i] = (i, 0, 1)
    sets = list(holders)
    parent, links, by_token = list(range(len(sets))), collections.Counter(), collections.defaultdict(list)

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for t in s for j in by_token[t]).items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[k] += 1
                links[j] += 1
                parent[find(k)] = find(j)
        for t in s:
            by_token[t].append(k)
    least = collections.defaultdict(list)
    for k, s in enumerate(sets):
        least[find(k)] += holders[s]
    for k, s in enumerate(sets):
        for i in holders[s]:
            out[i] = (min(least[find(k)]), links[k], len(holders[s]))
    return out


def near_documents(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    """For each id how many other rows are similar."""
    sets = [(i, shingles(t)) for i, t in rows]
    return {i: sum(5 * len(a & b) >= 4 * len(a | b) for k, (_, b) in enumerate(sets) if k != j and b) if a else 0 for j, (i, a) in enumerate(sets)}


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
