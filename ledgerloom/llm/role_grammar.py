"""Generalised LR repair of role sequences: a graph-structured stack over the role grammar, with weighted edits.

The grammar of a conversation's role initials is ``C -> empty | T | s T`` and ``T -> u a | T u a``. Rows are the input;
each may be kept (its initial is shifted), get another role, or be deleted, and roles without a row may be inserted.
All stacks live in one graph whose equal tops are one node, and of the ways to a node the one with the smallest
(cost, audit) stays.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from typing import NamedTuple

#: LR states: what is shifted on a role initial, what is reduced as soon as it is on top, and where that leads.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}
GOTO = {0: 3, 1: 4}
ACCEPTING = {0, 3, 4}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Kinds of rows.
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)
SYMBOLS = "sua"
ROLES = {"u": "user", "a": "assistant"}
#: A top that costs so much more than the cheapest one of its entry is never on a cheapest way: from the cheapest one two
#: inserts lead to where the same rows can follow, and one deletion stands for a system row that could be kept.
TOO_MUCH = 2 * INSERT + DELETE


def _graph() -> tuple[list[tuple[int, int | None]], list[dict[str, int]], list[int]]:
    """The nodes (LR state, node below), their moves by role initial, and those that are tops of stacks between rows."""
    nodes: list[tuple[int, int | None]] = [(0, None)]
    tops, moves = [0], {}

    def node(state: int, below: int) -> int:
        if (state, below) not in nodes:
            nodes.append((state, below))
        return nodes.index((state, below))

    for top in tops:
        moves[top] = {}
        for symbol in SYMBOLS:
            if (nodes[top][0], symbol) in SHIFT:
                new = node(SHIFT[nodes[top][0], symbol], top)
                while nodes[new][0] in REDUCE:
                    below = new
                    for _ in range(REDUCE[nodes[new][0]]):
                        below = nodes[below][1]
                    new = node(GOTO[nodes[below][0]], below)
                moves[top][symbol] = new
                if new not in tops:
                    tops.append(new)
    return nodes, [moves.get(i, {}) for i in range(len(nodes))], tops


NODES, MOVES, TOPS = _graph()


@cache
def _inserts(node: int) -> dict[int, str]:
    """The nodes that inserted roles lead to from a node, with the fewest roles."""
    found, wave = {node: ""}, [node]
    while wave:
        after = []
        for at in wave:
            for symbol in "ua":
                if (to := MOVES[at].get(symbol)) is not None and to not in found:
                    found[to] = found[at] + symbol
                    after.append(to)
        wave = after
    return found


@cache
def moves_over(symbol: str, kind: int) -> list[list[tuple[int, int, str, str]]]:
    """For each node the ways over one row: (node after it, cost, audit, roles of all but deletions).

    Rows have a role initial, or something else, as ``symbol``. Every audit ends in the row's own letter, so of two
    different ones over the same rows none is the beginning of another: their order stays whatever follows.
    """
    ways = []
    for node in range(len(NODES)):
        best: dict[int, tuple[int, str, str]] = {}
        for at, roles in _inserts(node).items():
            cost, audit = INSERT * len(roles), "I" * len(roles)
            found = [(at, cost + DELETE, audit + "D", roles)]
            if kind in (SOUND, CUT_OFF):
                cost += TRUNCATED * (kind == CUT_OFF)
                if symbol in MOVES[at]:
                    found.append((MOVES[at][symbol], cost, audit + "K", roles + symbol))
                found += [(MOVES[at][x], cost + REROLE, audit + "R", roles + x) for x in "ua" if x in MOVES[at]]
            for to, *rest in found:
                best[to] = min(best.get(to, (1 << 30, "", "")), tuple(rest))
        ways.append([(to, *rest) for to, rest in sorted(best.items())])
    return ways


@cache
def ends(node: int) -> tuple[int, str] | None:
    """(cost, roles) of the inserts that end a conversation at a node."""
    found = [(INSERT * len(roles), roles) for at, roles in _inserts(node).items() if NODES[at][0] in ACCEPTING]
    return min(found, default=None)


class Front(NamedTuple):
    """The tops of all stacks over a row: for each (entry, node) the cost and the place of its audit among all audits."""

    tops: tuple[tuple[int, int, int, int], ...]  # entry, node, cost, rank


def start(entries: Iterable[int]) -> Front:
    return Front(tuple((e, e, 0, 0) for e in entries))


@cache
def over(front: Front, symbol: str, kind: int) -> tuple[Front, int, dict]:
    """The front after a row, what its costs were reduced by, and for each top where it came from: (node, audit, roles).

    Costs are relative to the least one, so there are few different fronts and each is worked out once.
    """
    best: dict[tuple[int, int], tuple] = {}
    for entry, node, cost, rank in front.tops:
        for to, more, audit, roles in moves_over(symbol, kind)[node]:
            way = (cost + more, rank, audit, node, roles)
            best[entry, to] = min(best.get((entry, to), (1 << 60,)), way)
    own: dict[int, int] = {}
    for (entry, _), way in best.items():
        own[entry] = min(own.get(entry, 1 << 60), way[0])
    best = {key: way for key, way in best.items() if way[0] <= own[key[0]] + TOO_MUCH}
    least = min(own.values())
    ranks = {x: i for i, x in enumerate(sorted({way[1:3] for way in best.values()}))}
    front = Front(tuple((e, to, way[0] - least, ranks[way[1:3]]) for (e, to), way in sorted(best.items())))
    return front, least, {(e, to): (way[3], way[2], way[4]) for (e, to), way in best.items()}


def summary(rows: Iterable[tuple[str, int]]) -> list[tuple[int, int, int, int]]:
    """(entry, node, cost, rank) over a part of a conversation, from every node that it may begin at."""
    front, base = start(TOPS), 0
    for symbol, kind in rows:
        front, less, _ = over(front, symbol, kind)
        base += less
    return [(e, node, cost + base, rank) for e, node, cost, rank in front.tops]


def joined(parts: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """(cost, entry and exit node of each part, roles inserted at the end) of a conversation given as summaries.

    A part's ranks order its audits; those of a whole are ordered by the ranks of its parts, one after the other.
    """
    front, back = {0: (0, 0)}, []
    for part in parts:
        best: dict[int, tuple] = {}
        for entry, node, cost, rank in part:
            if entry in front:
                way = (front[entry][0] + cost, front[entry][1], rank, entry)
                best[node] = min(best.get(node, (1 << 62,)), way)
        ranks = {x: i for i, x in enumerate(sorted({way[1:3] for way in best.values()}))}
        front = {node: (way[0], ranks[way[1:3]]) for node, way in best.items()}
        back.append({node: way[3] for node, way in best.items()})
    cost, _, _, at, last = min((c + ends(n)[0], r, ends(n)[0], n, ends(n)[1]) for n, (c, r) in front.items() if ends(n))
    chosen = []
    for came in reversed(back):
        chosen.append((came[at], at))
        at = came[at]
    return cost, chosen[::-1], last


def repaired(rows: list[tuple[str, int]], entry: int, leave: int | None = None) -> tuple[int, str, list[str]]:
    """(cost, audit, for each row the roles that it leaves) from ``entry`` to ``leave``, or to the end of the conversation.

    The roles of a row are those inserted before it and, unless it is deleted, its own; at the end of a conversation
    one more entry has the roles inserted there.
    """
    front, base, back = start([entry]), 0, []
    for symbol, kind in rows:
        front, less, came = over(front, symbol, kind)
        base += less
        back.append(came)
    tops = {node: (cost + base, rank) for _, node, cost, rank in front.tops}
    if leave is None:
        cost, _, _, at, last = min((c + ends(n)[0], r, ends(n)[0], n, ends(n)[1]) for n, (c, r) in tops.items() if ends(n))
    else:
        cost, at, last = tops[leave][0], leave, ""
    audit, roles = ["I" * len(last)], [last]
    for came in reversed(back):
        at, letters, left = came[entry, at]
        audit.append(letters)
        roles.append(left)
    return cost, "".join(reversed(audit)), roles[::-1]
