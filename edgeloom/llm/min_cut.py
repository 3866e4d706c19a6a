"""Two labels for a few nodes by a minimum cut.

A node has a balance: what it costs to deny it the first label, less what it costs to grant it. An edge has the cost of
giving its two ends different labels. The cheapest labelling is a minimum cut, found by maximum flow; whole numbers only.
Where several cuts are as cheap, the one with the fewest nodes of the first label is taken, so the result is defined.
"""

from __future__ import annotations

from collections import deque


def min_cut(balance: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node gets the first label. Edges are (node, node, cost)."""
    near: list[dict[int, int]] = [{} for _ in balance]
    for a, b, cost in edges:
        if a != b and cost > 0:
            near[a][b] = near[a].get(b, 0) + cost
            near[b][a] = near[b].get(a, 0) + cost
    rest, label = _settle(list(balance), near)
    if rest:
        _flow(rest, near, label)
    return label


def _settle(balance: list[int], near: list[dict[int, int]]) -> tuple[dict[int, int], list[bool]]:
    """Nodes whose balance outweighs all their edges have their label in every cheapest cut; their edges become balance of
    the neighbours. Returns the balances of the others."""
    label, open_nodes = [False] * len(balance), dict.fromkeys(range(len(balance)))
    todo = deque(open_nodes)
    while todo:
        i = todo.popleft()
        if i not in open_nodes:
            continue
        pull = sum(near[i].values())
        if not (balance[i] > pull or balance[i] <= -pull):
            continue
        label[i] = balance[i] > 0
        del open_nodes[i]
        for j, cost in near[i].items():
            del near[j][i]
            balance[j] += cost if label[i] else -cost
            todo.append(j)
        near[i] = {}
    return {i: balance[i] for i in open_nodes}, label


def _flow(rest: dict[int, int], near: list[dict[int, int]], label: list[bool]) -> None:
    """Maximum flow from the nodes of positive balance to those of negative balance, along shortest paths by levels."""
    supply = {i: b for i, b in rest.items() if b > 0}
    room = {i: -b for i, b in rest.items() if b < 0}
    free = {i: dict(near[i]) for i in rest}  # what an edge can still carry, in each direction
    while True:
        level, queue = dict.fromkeys((i for i, s in supply.items() if s), 0), deque(i for i, s in supply.items() if s)
        reached = False
        while queue:
            i = queue.popleft()
            reached |= room.get(i, 0) > 0
            for j, c in free[i].items():
                if c and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            break
        left = {i: list(free[i]) for i in level}  # edges not yet found useless on these levels, the next one last
        for start in [i for i, s in supply.items() if s]:
            while supply[start] and (path := _path(start, level, left, free, room)):
                amount = min(supply[start], room[path[-1]], *(free[a][b] for a, b in zip(path, path[1:], strict=False)))
                supply[start] -= amount
                room[path[-1]] -= amount
                for a, b in zip(path, path[1:], strict=False):
                    free[a][b] -= amount
                    free[b][a] += amount
    for i in level:
        label[i] = True


def _path(start: int, level: dict, left: dict, free: dict, room: dict) -> list[int] | None:
    path = [start]
    while path:
        i = path[-1]
        if room.get(i, 0) > 0:
            return path
        while left[i] and not (free[i][left[i][-1]] and level.get(left[i][-1]) == level[i] + 1):
            left[i].pop()
        if left[i]:
            path.append(left[i][-1])
        else:
            path.pop()
            if path:
                left[path[-1]].pop()  # a dead end
    return None
