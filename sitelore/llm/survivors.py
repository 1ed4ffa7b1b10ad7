"""Cheapest edits of a run of turns: Viterbi over four dialogue states.

States: nothing said (or after an answer pair, state A), after the system turn (S), after the
user (U), after the assistant (A). Turns are read from the last to the first, so a state's
survivor is its best *ending*: every letter leads from a state to exactly one other, tied
endings differ in their first letter at the latest where they part, and comparing whole
endings from there gives the ASCII-least edits. (Read from the front, one tied beginning may
be a prefix of the other, and then only later turns decide.)

Survivors form a tree of back pointers with reference counts. Nodes that no survivor needs
are freed at once; as soon as all survivors share an ancestor, what it ends with is emitted.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
UNTERMINATED = 3  # a truncated turn that stays
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TURN = (USER, USER, ASSISTANT, USER)  # where a turn of the role that may follow leads, by state
ENDING = {START: "", SYSTEM: INSERT * 2, USER: INSERT, ASSISTANT: ""}
END_COSTS = tuple(len(ENDING[s]) * COST[INSERT] for s in range(4))
MUST_GO = ("b", "d")  # faults: blank, duplicate; "t" is truncated, "." none


class _Node:
    __slots__ = ("letter", "parent", "refs")

    def __init__(self, letter: str, parent: _Node | None):
        self.letter, self.parent, self.refs = letter, parent, 0
        if parent is not None:
            parent.refs += 1


def _release(node: _Node | None) -> None:
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node = node.parent


def _less(a: tuple[int, str, _Node], b: tuple[int, str, _Node]) -> bool:
    """Whether (cost, letter, rest) `a` comes before `b`: cheaper, or the lesser whole ending."""
    if a[0] != b[0]:
        return a[0] < b[0]
    letter, rest, other, tail = a[1], a[2], b[1], b[2]
    while letter == other and rest is not tail:
        if rest is None or tail is None:
            return rest is None
        letter, rest, other, tail = rest.letter, rest.parent, tail.letter, tail.parent
    return letter < other


class Survivors:
    """Best ending of each state, from the last turn backwards."""

    def __init__(self, costs: Sequence[int] = END_COSTS, endings: dict[int, str] | None = None):
        self.costs = list(costs)
        self.root = _Node("", None)
        self.out: list[str] = []  # emitted letters, the last edit first
        self.alive, self.most = 1, 1
        self.nodes = []
        for s in range(4):
            node = self.root
            for letter in reversed((ENDING if endings is None else endings)[s]):
                node = _Node(letter, node)
            node.refs += 1
            self.nodes.append(node)

    def before(self, initial: str, fault: str) -> None:
        """Take in the turn before those taken so far."""
        costs, nodes = self.costs, self.nodes
        if fault in MUST_GO:
            best = [(costs[s] + COST[DELETE], DELETE, nodes[s]) for s in range(4)]
        else:
            stays = UNTERMINATED if fault == "t" else 0
            legal = NEXT.get(initial, {})
            best = []
            for s in range(4):
                pick = (costs[s] + COST[DELETE], DELETE, nodes[s])
                t = legal.get(s)
                if t is not None:
                    option = (costs[t] + stays, KEEP, nodes[t])
                    pick = option if _less(option, pick) else pick
                t = TURN[s]
                option = (costs[t] + stays + COST[REROLE], REROLE, nodes[t])
                best.append(option if _less(option, pick) else pick)
        made: list[_Node | None] = [None] * 4
        new_costs = [0] * 4
        # inserted turns lead from U and A to each other, from the other two to U: at most two in a row
        plain = [best[USER][0], best[ASSISTANT][0]]
        for s in (USER, ASSISTANT):
            other = USER + ASSISTANT - s
            if plain[other - USER] + COST[INSERT] < plain[s - USER] or (
                plain[other - USER] + COST[INSERT] == plain[s - USER] and INSERT < best[s][1]
            ):
                continue  # made below, from the other's own node
            made[s], new_costs[s] = _Node(best[s][1], best[s][2]), best[s][0]
        for s in (USER, ASSISTANT):
            if made[s] is None:
                other = USER + ASSISTANT - s
                made[s], new_costs[s] = _Node(INSERT, made[other]), new_costs[other] + COST[INSERT]
        for s in (START, SYSTEM):
            option = (new_costs[USER] + COST[INSERT], INSERT, made[USER])
            pick = option if _less(option, best[s]) else best[s]
            made[s], new_costs[s] = _Node(pick[1], pick[2]), pick[0]
        for node in made:
            node.refs += 1
        for node in nodes:
            _release(node)
        self.costs, self.nodes = new_costs, made
        if self.root.refs == 1:
            self._emit()

    def _emit(self) -> None:
        path, node = [], self.nodes[0]
        while node is not self.root:
            path.append(node)
            node = node.parent
        while path and self.root.refs == 1:
            self.root = path.pop()
            self.root.parent = None
            self.out.append(self.root.letter)
            if any(n is self.root for n in self.nodes):
                break

    def unresolved(self) -> int:
        """Nodes of the longest ending that is not emitted yet."""
        most = 0
        for node in self.nodes:
            n = 0
            while node is not self.root:
                n, node = n + 1, node.parent
            most = max(most, n)
        return most

    def edits(self, state: int = START) -> str:
        """Letters of the best edits from `state` in front of all turns taken."""
        front, node = [], self.nodes[state]
        while node is not self.root:
            front.append(node.letter)
            node = node.parent
        return "".join(front) + "".join(reversed(self.out))


def transfer(turns: Iterable[tuple[str, str]]) -> list[list[int]]:
    """Costs [entry][exit] of the cheapest edits of turns (initial, fault), given in order."""
    inf = 1 << 60
    rows = [[0 if s == t else inf for t in range(4)] for s in range(4)]
    for initial, fault in reversed(list(turns)):
        stays, legal = UNTERMINATED if fault == "t" else 0, NEXT.get(initial, {})
        new = []
        for s in range(4):
            row = [c + COST[DELETE] for c in rows[s]]
            if fault not in MUST_GO:
                for t, cost in ((legal.get(s), stays), (TURN[s], stays + COST[REROLE])):
                    if t is not None:
                        row = [min(a, b + cost) for a, b in zip(row, rows[t])]
            new.append(row)
        u, a = new[USER], new[ASSISTANT]
        new[USER] = [min(x, y + COST[INSERT]) for x, y in zip(u, a)]
        new[ASSISTANT] = [min(x, y + COST[INSERT]) for x, y in zip(a, u)]
        for s in (START, SYSTEM):
            new[s] = [min(x, y + COST[INSERT]) for x, y in zip(new[s], new[USER])]
        rows = new
    return rows
