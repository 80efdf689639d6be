"""Dependency rules of one parsed sentence (X2-X7, J10, J11): helper of ``operators.dependency``, called over Arrow batches."""

from __future__ import annotations


def _closure(pointer: dict[int, int], n: int):
    """The end of the chain from a token, kept per token; at most ``n`` steps, so a cycle ends as well."""
    ends: dict[int, int] = {}

    def walk(start: int) -> int:
        path, cur = [], start
        while cur in pointer and cur not in ends and len(path) < n:
            path.append(cur)
            cur = pointer[cur]
        if len(path) < n or cur not in pointer:
            cur = ends.get(cur, cur)
            ends.update(dict.fromkeys(path, cur))
        return cur

    return walk


def sentence_triples(words: list | None, heads: list | None, rels: list | None) -> list[dict] | None:
    """The triples of a sentence with exactly one HED arc, else None; positions count from 0 at its first token."""
    if words is None or heads is None or rels is None:
        return None
    n = len(heads)
    roots = [i for i, r in enumerate(rels[:n], 1) if r == "HED"]
    if len(roots) != 1:
        return None
    children: dict[int, list[tuple[int, str]]] = {}
    first_att: dict[int, int] = {}
    last_vob: dict[int, int] = {}
    for i, (h, r) in enumerate(zip(heads, rels), 1):
        if h is None:
            continue
        children.setdefault(h, []).append((i, r))
        if 1 <= h <= n and r in ("ATT", "SBV"):
            first_att.setdefault(h, i)
        elif 1 <= h <= n and r == "VOB":
            last_vob[h] = i
    leftmost, rightmost = _closure(first_att, n), _closure(last_vob, n)

    def of(parent: int, kind: str) -> list[int]:
        return [i for i, r in children.get(parent, ()) if r == kind]

    def span(lo: int, hi: int) -> list[str]:
        return [w for w in words[lo - 1:hi] if w is not None] if hi >= lo else []

    out = []
    for rel_pos, rel in enumerate([roots[0], *of(roots[0], "COO")]):
        subjects = of(rel, "SBV") or [i for i, _ in children.get(rel, ()) if i < rel]
        left = subjects[-1] if subjects else None
        lo = None if left is None else leftmost(left)
        row = {"rel_pos": rel_pos, "rel": words[rel - 1], "e1": "" if left is None else " ".join(span(lo, left)),
               "e1_loc": None if left is None else lo - 1}
        right = of(rel, "VOB")
        if not right:
            out.append(row | {"item": 0, "e2": "", "e2_loc": None})
            continue
        first, ext = right[0], rightmost(right[0])
        for k, item in enumerate([*right, *of(ext, "COO")]):
            lo = leftmost(item)
            e2 = span(lo, ext) if k == 0 else span(lo, first - 1) + span(item, rightmost(item))
            out.append(row | {"item": k, "e2": " ".join(e2), "e2_loc": 0 if k else lo - 1})
    return out
