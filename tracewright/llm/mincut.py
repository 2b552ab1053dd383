"""Binary labelling by minimum cut."""

from __future__ import annotations

from collections import deque


def label(keep: list[int], drop: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """For each node, whether it is kept, at the least total cost.

    Keeping node i costs ``keep[i]``, dropping it ``drop[i]``, and labelling the ends of an edge differently its weight. These are capacities
    of a flow network: source to i has drop[i], i to sink keep[i], and an edge its weight either way; what the source still reaches
    after a maximum flow is kept. A node whose preference outweighs all its undecided edges has that label in a minimum cut, so it is settled first and
    its edges are added to its neighbours' costs. Costs are whole and not negative.
    """
    n = len(keep)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    keep, drop = list(keep), list(drop)
    weight = [sum(x.values()) for x in near]
    kept: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if kept[i] is not None or abs(drop[i] - keep[i]) < weight[i]:
            continue
        kept[i] = drop[i] > keep[i]
        for j, w in near[i].items():
            if kept[j] is None:
                weight[j] -= w
                if kept[i]:
                    drop[j] += w
                else:
                    keep[j] += w
                queue.append(j)
    rest = [i for i in range(n) if kept[i] is None]
    if rest:
        for i, source_side in zip(rest, _cut(rest, keep, drop, near), strict=True):
            kept[i] = source_side
    return [bool(x) for x in kept]


def _cut(nodes: list[int], keep: list[int], drop: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Which of ``nodes`` are on the source's side of a minimum cut: augmenting paths along levels, as Dinic's method has it."""
    at = {v: k for k, v in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    room: list[dict[int, int]] = [{} for _ in range(len(nodes) + 2)]
    for v, k in at.items():
        both = min(keep[v], drop[v])  # a path of two edges takes this at once
        room[source][k], room[k][source] = drop[v] - both, 0
        room[k][sink], room[sink][k] = keep[v] - both, 0
        for u, w in near[v].items():
            if u in at:
                room[k][at[u]] = w
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for u, r in room[v].items():
                if r > 0 and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return [k in level for k in range(len(nodes))]
        options = {v: iter(list(room[v])) for v in level}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                back = 0
                for i, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    room[a][b] -= flow
                    room[b][a] += flow
                    if not room[a][b] and not back:
                        back = i + 1
                del path[back:]
                continue
            for u in options[v]:
                if room[v][u] > 0 and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                path.pop()
                if path:
                    level[v] = -1
