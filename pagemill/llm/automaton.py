"""Byte automata: a small regex syntax to an NFA, subset construction, minimisation, transition arrays.

Syntax: literals, ``[...]`` with ranges, ``(a|b)``, ``?``, ``*``, ``+``, ``{n}``, ``\\xHH`` and escaped punctuation;
``(?i)`` at the start lets ASCII letters match in either case. Patterns are over bytes.
"""

from __future__ import annotations

import numpy as np

# A parsed pattern: ("set", frozenset of bytes) | ("cat", parts) | ("alt", parts) | ("star" | "plus" | "opt", part)


def parse(pattern: str):
    fold = pattern.startswith("(?i)")
    src, at = pattern[4 * fold :], 0

    def one(c: str) -> frozenset[int]:
        return frozenset({ord(c.lower()), ord(c.upper())} if fold else {ord(c)})

    def escaped() -> str:
        nonlocal at
        at += 1
        if src[at] == "x":
            at += 3
            return chr(int(src[at - 2 : at], 16))
        at += 1
        return src[at - 1]

    def klass():
        nonlocal at
        at += 1
        out: set[int] = set()
        while src[at] != "]":
            lo = escaped() if src[at] == "\\" else src[(at := at + 1) - 1]
            if src[at] == "-" and src[at + 1] != "]":
                at += 1
                hi = escaped() if src[at] == "\\" else src[(at := at + 1) - 1]
            else:
                hi = lo
            for x in range(ord(lo), ord(hi) + 1):
                out |= one(chr(x))
        at += 1
        return ("set", frozenset(out))

    def alternatives():
        nonlocal at
        ways = [[]]
        while at < len(src) and src[at] != ")":
            c = src[at]
            if c == "|":
                at += 1
                ways.append([])
                continue
            if c == "(":
                at += 1
                atom = alternatives()
                at += 1
            elif c == "[":
                atom = klass()
            elif c == "\\":
                atom = ("set", one(escaped()))
            else:
                at += 1
                atom = ("set", one(c))
            while at < len(src) and src[at] in "?*+{":
                q = src[at]
                if q == "{":
                    end = src.index("}", at)
                    atom, at = ("cat", [atom] * int(src[at + 1 : end])), end + 1
                else:
                    atom, at = ({"?": "opt", "*": "star", "+": "plus"}[q], atom), at + 1
            ways[-1].append(atom)
        return ("alt", [("cat", w) for w in ways]) if len(ways) > 1 else ("cat", ways[0])

    return alternatives()


def reverse(tree):
    kind, x = tree
    if kind == "set":
        return tree
    if kind in ("cat", "alt"):
        return (kind, [reverse(p) for p in (reversed(x) if kind == "cat" else x)])
    return (kind, reverse(x))


class Dfa:
    """classes: byte -> class; table: (state, class) -> state; accepts: state -> frozenset of rules. State 0 starts, -1 is dead."""

    def __init__(self, classes: np.ndarray, table: np.ndarray, accepts: list[frozenset[int]]):
        self.classes, self.table, self.accepts = classes, table, accepts


def compile_dfa(trees: list, search: bool) -> Dfa:
    """One minimal automaton for all rules; with ``search``, a match may begin anywhere."""
    eps: list[list[int]] = []
    moves: list[list[tuple[frozenset[int], int]]] = []

    def new() -> int:
        eps.append([]), moves.append([])
        return len(eps) - 1

    def build(tree, a: int) -> int:
        kind, x = tree
        if kind == "set":
            b = new()
            moves[a].append((x, b))
            return b
        if kind == "cat":
            for p in x:
                a = build(p, a)
            return a
        b = new()
        if kind == "alt":
            for p in x:
                s = new()
                eps[a].append(s)
                eps[build(p, s)].append(b)
            return b
        s = new()
        eps[a].append(s)
        e = build(x, s)
        eps[e].append(b)
        if kind in ("star", "plus"):
            eps[e].append(s)
        if kind in ("star", "opt"):
            eps[a].append(b)
        return b

    root, final = new(), {}
    for r, t in enumerate(trees):
        s = new()
        eps[root].append(s)
        final[build(t, s)] = r
    # bytes that no rule tells apart form a class
    sets = sorted({s for m in moves for s, _ in m}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], dtype=np.uint8)
    member = {s: {int(classes[b]) for b in s} for s in sets}

    def closure(states) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in eps[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(x for x in out if moves[x] or x in final)

    begin = closure([root])
    number, order, rows = {begin: 0}, [begin], []
    for now in order:
        step: list[set[int]] = [set(begin) if search else set() for _ in kinds]
        for s in now:
            for chars, t in moves[s]:
                for c in member[chars]:
                    step[c].add(t)
        row = []
        for target in step:
            to = closure(target) if target else None
            if to is None or not to:
                row.append(-1)
                continue
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    accepts = [frozenset(final[s] for s in now if s in final) for now in order]
    table = np.array(rows, dtype=np.int32)
    # minimisation by refining blocks until transitions agree; the dead state is a block of its own
    labels = sorted(set(accepts), key=sorted)
    block = np.array([labels.index(a) for a in accepts])
    while True:
        key = np.column_stack([block, np.where(table < 0, -1, block[table])])
        _, first, fresh = np.unique(key, axis=0, return_index=True, return_inverse=True)
        fresh = fresh.reshape(-1)
        if fresh.max() == block.max():
            break
        block = fresh
    rename = {int(b): i for i, b in enumerate(dict.fromkeys(block.tolist()))}  # the start's block comes first
    keep = {rename[int(block[i])]: i for i in range(len(order) - 1, -1, -1)}
    small = np.array([[-1 if t < 0 else rename[int(block[t])] for t in table[keep[i]]] for i in range(len(keep))], dtype=np.int32)
    return Dfa(classes, small, [accepts[keep[i]] for i in range(len(keep))])


def linked(dfa: Dfa, sink: bool = False) -> tuple[list[list], dict[int, frozenset[int]], list]:
    """Rows that hold the rows they lead to, so that ``row = row[byte]`` is a step. With ``sink``, accepting rows lead to
    themselves. Gives the rows, the accepting rows' rules by id(), and the dead row."""
    rows: list[list] = [[] for _ in dfa.accepts]
    dead: list = []
    dead.extend([dead] * 256)
    for i, row in enumerate(rows):
        if sink and dfa.accepts[i]:
            row.extend([row] * 256)
        else:
            row.extend(dead if t < 0 else rows[t] for t in dfa.table[i][dfa.classes].tolist())
    return rows, {id(rows[i]): a for i, a in enumerate(dfa.accepts) if a}, dead
