"""Nested schemas as trees and the cheapest script that turns one into another."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

#: Cost of adding or removing one node; a rename costs less than one of each.
EDIT, RETYPE = 1.0, 0.4
#: Least likeness of two fields of one type for which a rename is cheaper than removing and adding.
RENAME_FROM = 0.52


@dataclass
class Node:
    """One field: its name, type class, children and what is known about its values."""

    name: str
    kind: str
    children: list[Node] = field(default_factory=list)
    n: float = 0
    local: dict[int, float] = field(default_factory=dict)
    general: dict[int, float] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass
class Change:
    kind: str  # added, removed, renamed, retyped, moved
    path: str  # in the later schema; for removed in the earlier
    before: str | None = None
    type_before: str | None = None
    type_after: str | None = None
    depth: int = 1  # of the field in the schema that ``path`` is a path of
    depth_before: int = 1


def type_class(name: str) -> str:
    """The JSON type of a variant schema name; ``void`` for null only."""
    head = re.match(r"[A-Z_]+", name)
    head = head.group() if head else ""
    if head == "DECIMAL":
        precision, scale = map(int, re.findall(r"\d+", name)[:2])
        return "integer" if precision > 18 and scale == 0 else "decimal"
    return {"STRING": "string", "BOOLEAN": "boolean", "BIGINT": "integer", "DOUBLE": "decimal", "FLOAT": "decimal", "ARRAY": "array", "OBJECT": "object", "VOID": "void", "VARIANT": "variant"}.get(head, "string")


def parse_type(name: str, label: str = "") -> Node:
    """The tree of a variant schema name such as ``OBJECT<a: BIGINT, b: OBJECT<c: STRING>>``."""
    at = 0

    def label_here() -> str:
        nonlocal at
        if name[at] == "`":
            end = at + 1
            while name[end] != "`" or name[end : end + 2] == "``":
                end += 2 if name[end] == "`" else 1
            out, at = name[at + 1 : end].replace("``", "`"), end + 1
        else:
            end = name.index(":", at)
            out, at = name[at:end], end
        return out

    def node(own: str) -> Node:
        nonlocal at
        word = re.compile(r"[A-Z_]+(\(\d+,\d+\))?").match(name, at)
        at = word.end()
        out = Node(own, type_class(word.group()))
        if name[at : at + 1] == "<":
            at += 1
            if out.kind == "array":
                out.children.append(node("[]"))
            while name[at] != ">":
                if name[at] in ", ":
                    at += 1
                    continue
                child = label_here()
                at += 1
                while name[at] == " ":
                    at += 1
                out.children.append(node(child))
            at += 1
        return out

    return node(label)


def name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)] or [name.lower()]


def name_likeness(a: str, b: str) -> float:
    """Share of the words of the shorter name that the other has, a prefix of three letters counting."""
    short, long = sorted((name_words(a), name_words(b)), key=len)
    hits = sum(any(w == v or (min(len(w), len(v)) >= 3 and (w.startswith(v) or v.startswith(w))) for v in long) for w in short)
    return hits / len(short)


def cosine(a: dict[int, float], b: dict[int, float]) -> float:
    dot = sum(v * b.get(k, 0.0) for k, v in a.items())
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return dot / norm if norm else 0.0


def likeness(a: Node, b: Node) -> float:
    """How likely two fields of one type are the same field: values of both files, values of the names everywhere, names."""
    n = min(a.n, b.n)
    near = cosine(a.local, b.local) if a.local and b.local else 0.0
    values = (n * near + 5 * cosine(a.general, b.general)) / (n + 5)
    names = name_likeness(a.name, b.name)
    if "boolean" in (a.kind, b.kind):  # any two flags have like values
        return 0.25 * values + 0.75 * names
    return 0.65 * values + 0.35 * names


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in a cheapest complete assignment; rows may not outnumber columns."""
    rows, cols = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (rows + 1), [0.0] * (cols + 1), [0] * (cols + 1)
    for i in range(1, rows + 1):
        match[0], j0 = i, 0
        least, used, way = [math.inf] * (cols + 1), [False] * (cols + 1), [0] * (cols + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, cols + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(cols + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * rows
    for j in range(1, cols + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def _rename_cost(a: Node, b: Node) -> float:
    """Below two edits exactly when the likeness reaches ``RENAME_FROM``; infinite for other types."""
    if a.kind != b.kind and "void" not in (a.kind, b.kind):
        return math.inf
    near = likeness(a, b)
    return 2 * EDIT * (1 - near) / (1 - RENAME_FROM) + 1e-9 if near >= RENAME_FROM else math.inf


def script(before: list[Node], after: list[Node], prefix: str = "", prefix_before: str = "", depth: int = 1) -> tuple[float, list[Change]]:
    """Cost and changes of the cheapest script between two lists of sibling fields.

    Fields of one name are one field, whose type and children may change. The others are
    matched as a whole by a cheapest assignment in which every field may also be removed
    or added; children are compared under matched fields only.
    """
    old, new = {n.name: n for n in before}, {n.name: n for n in after}
    cost, changes = 0.0, []

    def inside(a: Node, b: Node) -> None:
        nonlocal cost
        if a.kind == b.kind and a.kind in ("object", "array"):
            more, below = script(a.children, b.children, f"{prefix}{b.name}.", f"{prefix_before}{a.name}.", depth + 1)
            cost += more
            changes.extend(below)

    for name in sorted(old.keys() & new.keys()):
        a, b = old[name], new[name]
        if a.kind != b.kind and "void" not in (a.kind, b.kind):
            cost += RETYPE
            changes.append(Change("retyped", prefix + name, prefix_before + name, a.kind, b.kind, depth, depth))
        inside(a, b)
    gone = [old[k] for k in sorted(old.keys() - new.keys())]
    come = [new[k] for k in sorted(new.keys() - old.keys())]
    # every field may also go (its own extra column) or come (the extra rows)
    big = 1e6
    table = [[min(_rename_cost(a, b), big) for b in come] + [EDIT * a.size() if i == k else big for k in range(len(gone))] for i, a in enumerate(gone)]
    table += [[EDIT * b.size() if j == k else big for j, b in enumerate(come)] + [0.0] * len(gone) for k in range(len(come))]
    place = assign(table) if table and table[0] else []
    taken = set()
    for i, a in enumerate(gone):
        j = place[i]
        if j < len(come) and table[i][j] < big:
            b = come[j]
            taken.add(j)
            cost += table[i][j]
            changes.append(Change("renamed", prefix + b.name, prefix_before + a.name, a.kind, b.kind, depth, depth))
            inside(a, b)
        else:
            cost += EDIT * a.size()
            changes.append(Change("removed", prefix_before + a.name, prefix_before + a.name, a.kind, None, depth, depth))
    for j, b in enumerate(come):
        if j not in taken:
            cost += EDIT * b.size()
            changes.append(Change("added", prefix + b.name, None, None, b.kind, depth, depth))
    return cost, changes


#: Cost of moving a field: less than removing and adding it, more than any likely rename.
MOVE = 1.2


def _paths(fields: list[Node], prefix: str = "") -> dict[str, Node]:
    out: dict[str, Node] = {}
    for n in fields:
        out[prefix + n.name] = n
        if n.kind == "object":
            out.update(_paths(n.children, f"{prefix}{n.name}."))
    return out


def _without(fields: list[Node], path: str) -> list[Node]:
    """The fields without the one at a path; only the nodes on the way are made anew."""
    head, _, rest = path.partition(".")
    if not rest:
        return [n for n in fields if n.name != head]
    return [Node(n.name, n.kind, _without(n.children, rest), n.n, n.local, n.general) if n.name == head else n for n in fields]


def cheapest(before: list[Node], after: list[Node]) -> tuple[float, list[Change]]:
    """Cost and changes of the cheapest script in which fields may also move between objects.

    A move costs ``MOVE`` and what changes inside the field; it keeps the name and the type. Moves
    are taken one at a time, the one that lowers the cost of the whole script most first, as long
    as one does.
    """
    old, new = _paths(before), _paths(after)
    leaves: dict[tuple[str, str], list[str]] = {}
    for path, n in new.items():
        if path not in old:
            leaves.setdefault((n.name, n.kind), []).append(path)
    options = [(p, q) for p, n in old.items() if p not in new for q in leaves.get((n.name, n.kind), ())]
    cost, changes = script(before, after)
    moved: list[Change] = []
    total = 0.0
    while options:
        tried = []
        for p, q in options:
            inner, below = script(old[p].children, new[q].children, f"{q}.", f"{p}.", q.count(".") + 2) if old[p].kind == "object" else (0.0, [])
            rest, left = script(_without(before, p), _without(after, q))
            tried.append((rest + MOVE + inner, p, q, left, below, MOVE + inner))
        best = min(tried, key=lambda t: t[:3])
        if best[0] >= cost:
            break
        _, p, q, changes, below, own = best
        before, after = _without(before, p), _without(after, q)
        moved += [Change("moved", q, p, old[p].kind, new[q].kind, q.count(".") + 1, p.count(".") + 1), *below]
        total += own
        cost = best[0] - own
        inside = lambda path, of: path == of or path.startswith(of + ".")
        options = [(a, b) for a, b in options if not inside(a, p) and not inside(b, q) and not inside(p, a) and not inside(q, b)]
    return cost + total, moved + changes
