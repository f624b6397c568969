"""Shortest paths by auction through the lattice of repairs of one stretch of a conversation."""

from __future__ import annotations

from dataclasses import dataclass

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. The first and the last may end.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FREE = float("inf")

#: Cost of ending in each state where the conversation ends.
ENDING = (0, FREE, FREE, 0)


def wanted(state: int) -> str:
    """The role initial that an inserted or reroled row has in a state: the only one the form allows."""
    return "a" if state == 2 else "u"


@dataclass(frozen=True)
class Step:
    """A row of the lattice: its initial (None: it must go, with `copies` rows like it), and whether it is truncated."""

    initial: str | None
    cut: bool = False
    copies: int = 1


class Lattice:
    """Arcs between (rows passed, state); node number rows * STATES + state, the sink last.

    `ends` are the costs of going on from each state after the last row. Rows may be inserted before each
    row, and behind the last one only where the conversation ends. All prices are final once it is made:
    nodes are settled from the sink backwards, so that paths stay short.
    """

    def __init__(self, steps: tuple[Step, ...], ends: tuple[float, ...], last: bool) -> None:
        self.sink = (len(steps) + 1) * STATES
        self.deleted = [step.copies if step.initial is None else 1 for step in steps]
        self.arcs = [self._arcs(steps, ends, last, node) for node in range(self.sink)] + [[]]
        self._drop_dead_ends()
        least = [min([e for e in ends if e < FREE], default=0)]
        for step in reversed(steps):
            least.append(least[-1] + (DELETE * step.copies if step.initial is None else TRUNCATED * step.cut))
        # What the rows to come cost at the least: no arc is longer than its ends' prices differ, as an auction needs.
        self.price = [least[len(steps) - node // STATES] for node in range(self.sink)] + [0]
        self.settled = {self.sink}
        for node in reversed(range(self.sink)):
            self.settle(node)

    def _drop_dead_ends(self) -> None:
        """Take out arcs to nodes from which the sink cannot be reached: prices there would rise for ever."""
        alive = {self.sink}
        for row in reversed(range(0, self.sink, STATES)):
            for _ in range(2):  # insertions lead from state 2 to 3 and back within a row
                alive.update(n for n in range(row, row + STATES) if any(head in alive for _, _, head in self.arcs[n]))
        self.arcs = [[arc for arc in arcs if arc[2] in alive] for arcs in self.arcs]

    @staticmethod
    def _arcs(steps: tuple[Step, ...], ends: tuple[float, ...], last: bool, node: int) -> list[tuple[str, float, int]]:
        """(edit, cost, head) of the arcs that leave a node, by edit; ending has no letter and comes first."""
        at, state = divmod(node, STATES)
        sink, below = (len(steps) + 1) * STATES, node - state + STATES
        forced = NEXT[state, wanted(state)]
        insert = ("I", INSERT, node - state + forced)
        if at == len(steps):
            return ([("", ends[state], sink)] if ends[state] < FREE else []) + [insert] * last
        step = steps[at]
        if step.initial is None:
            return [("D", DELETE * step.copies, below + state), insert]
        extra = TRUNCATED * step.cut
        out = [("D", DELETE, below + state), insert]
        if (state, step.initial) in NEXT:
            out.append(("K", extra, below + NEXT[state, step.initial]))
        return [*out, ("R", REROLE + extra, below + forced)]

    def settle(self, origin: int) -> None:
        """Raise prices until that of `origin` is its distance to the sink.

        The path from the origin is extended over the cheapest arc of its last node if the node's price
        is what that arc and its head cost, else the price rises to it and the path is contracted by the
        node. It ends at a node settled before, and then all nodes of the path are settled.
        """
        price, path = self.price, [origin]
        while path[-1] not in self.settled:
            node = path[-1]
            best, head = min(((cost + price[to], to) for _, cost, to in self.arcs[node]), default=(FREE, node))
            if best > price[node]:
                price[node] = best
                if best == FREE:
                    self.settled.add(node)
                elif len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        self.settled.update(path)

    def distance(self, state: int) -> float:
        """Cost of the cheapest edits from a state ahead of the first row; FREE if there are none."""
        return self.price[state]

    def trace(self, state: int) -> tuple[str, int]:
        """Letters of the cheapest path whose letters come first in ASCII order, and the state before its end.

        Prices being distances, the arcs of cheapest paths are the tight ones; the first tight letter is taken
        at each node. Ending has no letter and so comes before all others.
        """
        node, letters = state, []
        while True:
            edit, _, head = next(arc for arc in self.arcs[node] if self.price[node] == arc[1] + self.price[arc[2]])
            if head == self.sink:
                return "".join(letters), node % STATES
            if edit == "D":
                edit *= self.deleted[node // STATES]
            letters.append(edit)
            node = head


def crossing(steps: tuple[Step, ...]) -> tuple[tuple[float, ...], ...]:
    """Costs of the cheapest edits from each state ahead of a stretch to each state behind it, if more follows."""
    behind = [tuple(0 if s == t else FREE for t in range(STATES)) for s in range(STATES)]
    columns = [Lattice(steps, ends, False).price[:STATES] for ends in behind]
    return tuple(zip(*columns, strict=True))


def ahead(matrix: tuple[tuple[float, ...], ...], ends: tuple[float, ...]) -> tuple[float, ...]:
    """Costs of going on from each state ahead of a stretch, by its crossing costs and those behind it."""
    return tuple(min(cost + end for cost, end in zip(row, ends, strict=True)) for row in matrix)
