"""Graph kernels on one small subgraph: sorted node ids and a list of edges in, lists of node ids out.

They run in Arrow batches on the executors. Ties are broken by node id, so results don't depend on input order.
"""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import combinations

class Graph:
    """Adjacency of a subgraph: ``out`` follows arcs, ``near`` ignores their direction."""

    def __init__(self, nodes: Iterable[int], edges: Iterable[tuple[int, int]], directed: bool):
        self.nodes, self.edges, self.directed = sorted(nodes), [tuple(e) for e in edges], directed
        self.near: dict[int, set[int]] = {n: set() for n in self.nodes}
        self.out = {n: set() for n in self.nodes} if directed else self.near
        for u, v in self.edges:
            self.near[u].add(v)
            self.near[v].add(u)
            if directed:
                self.out[u].add(v)

    def part(self, nodes: Iterable[int]) -> Graph:
        keep = set(nodes)
        return Graph(keep, [e for e in self.edges if e[0] in keep and e[1] in keep], self.directed)


def distances(steps: dict[int, set[int]], source: int, limit: int | None = None) -> dict[int, int]:
    found, queue = {source: 0}, deque([source])
    while queue:
        u = queue.popleft()
        if limit is not None and found[u] >= limit:
            continue
        for v in steps[u]:
            if v not in found:
                found[v] = found[u] + 1
                queue.append(v)
    return found


def components(g: Graph) -> list[list[int]]:
    left, out = set(g.nodes), []
    for n in g.nodes:
        if n in left:
            part = distances(g.near, n)
            left -= part.keys()
            out.append(sorted(part))
    return out


def neighborhood(g: Graph, low: int, high: int) -> Iterator[list[int]]:
    for n in g.nodes:
        far = distances(g.out, n, high)
        for r in range(low, high + 1):
            yield sorted(v for v, d in far.items() if d <= r)


def of_degree(g: Graph, low: int, high: int) -> list[list[int]]:
    """The nodes of a degree in range; an arc counts at both its ends."""
    count = dict.fromkeys(g.nodes, 0)
    for u, v in g.edges:
        count[u] += 1
        count[v] += 1
    return [[n for n in g.nodes if low <= count[n] <= high]]


def _forest(g: Graph) -> tuple[dict[int, int | None], dict[int, int]]:
    parent: dict[int, int | None] = {}
    depth: dict[int, int] = {}
    for root in g.nodes:
        if root in parent:
            continue
        parent[root], depth[root] = None, 0
        queue = deque([root])
        while queue:
            u = queue.popleft()
            for v in sorted(g.near[u]):
                if v not in parent:
                    parent[v], depth[v] = u, depth[u] + 1
                    queue.append(v)
    return parent, depth


def cycles(g: Graph) -> Iterator[list[int]]:
    """Undirected: the fundamental cycles of the breadth-first forest from the smallest ids; directed: all simple cycles, one by one."""
    return _directed_cycles(g) if g.directed else iter(_fundamental_cycles(g))


def _fundamental_cycles(g: Graph) -> list[list[int]]:
    return [ring for _, ring in rings(g)]


def rings(g: Graph) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """Each edge beyond the breadth-first forest, direction ignored, with the nodes of the cycle that it closes."""
    parent, depth = _forest(g)
    for u, v in sorted((min(e), max(e)) for e in g.edges):
        if u == v:
            yield (u, v), [u]
        elif parent[u] != v and parent[v] != u:
            ring, a, b = {u, v}, u, v
            while a != b:
                if depth[a] < depth[b]:
                    a, b = b, a
                a = parent[a]
                ring.add(a)
            yield (u, v), sorted(ring)


def strong_components(nodes: list[int], out: dict[int, set[int]]) -> list[list[int]]:
    """Strongly connected components of the subgraph on ``nodes``: depth-first, a component is what stands above its first node."""
    among, number, low, out_of, stack, found = set(nodes), {}, {}, set(), [], []
    for root in nodes:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        stack.append(root)
        work = [(root, iter(out[root]))]
        while work:
            u, ahead = work[-1]
            for v in ahead:
                if v not in among or v in out_of:
                    continue
                if v not in number:
                    number[v] = low[v] = len(number)
                    stack.append(v)
                    work.append((v, iter(out[v])))
                    break
                low[u] = min(low[u], number[v])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[u])
                if low[u] == number[u]:
                    part = []
                    while not part or part[-1] != u:
                        part.append(stack.pop())
                    out_of.update(part)
                    found.append(sorted(part))
    return found


def _directed_cycles(g: Graph) -> Iterator[list[int]]:
    """All simple cycles, each from its smallest node, one by one.

    Searched inside strong components only, since a cycle leaves none. A node from which the start wasn't reached is blocked
    until a node that it was blocked by is free again, so no dead end is walked twice without a cycle in between.
    """
    left = [c for c in strong_components(g.nodes, g.out) if len(c) > 1 or c[0] in g.out[c[0]]]
    while left:
        part = left.pop()
        start, own = part[0], set(part)
        path, on, waiting, closed = [start], {start}, defaultdict(set), set()
        work = [(start, iter(sorted(g.out[start] & own)))]
        while work:
            u, ahead = work[-1]
            for v in ahead:
                if v == start:
                    yield sorted(path)
                    closed.update(path)
                elif v not in on:
                    path.append(v)
                    on.add(v)
                    closed.discard(v)
                    work.append((v, iter(sorted(g.out[v] & own))))
                    break
            else:
                work.pop()
                path.pop()
                if u in closed:  # a cycle went through it: free it and all that wait for it
                    free = [u]
                    while free:
                        w = free.pop()
                        if w in on:
                            on.discard(w)
                            free += waiting.pop(w, ())
                else:
                    for v in g.out[u] & own:
                        waiting[v].add(u)
        left += [c for c in strong_components(part[1:], g.out) if len(c) > 1 or c[0] in g.out[c[0]]]


def bridges(g: Graph) -> list[tuple[int, int]]:
    """Edges on no cycle. Undirected: by low-link; directed: arcs between strongly connected components."""
    if g.directed:
        reach = {n: set(distances(g.out, n)) for n in g.nodes}
        return [(u, v) for u, v in g.edges if u not in reach[v]]
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    found = []
    for root in g.nodes:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(sorted(g.near[root])))]
        while stack:
            u, came, it = stack[-1]
            v = next(it, None)
            if v is None:
                stack.pop()
                if came is not None:
                    low[came] = min(low[came], low[u])
                    if low[u] > order[came]:
                        found.append((min(u, came), max(u, came)))
            elif v not in order:
                order[v] = low[v] = len(order)
                stack.append((v, u, iter(sorted(g.near[v]))))
            elif v != came:
                low[u] = min(low[u], order[v])
    return found


def trees(g: Graph) -> list[list[int]]:
    return [c for c in components(Graph(g.nodes, bridges(g), g.directed)) if len(c) > 1]


def geodesics(g: Graph, low: int, high: int) -> list[list[int]]:
    """Distinct node sets of shortest paths of low to high edges."""
    found: set[tuple[int, ...]] = set()
    for s in g.nodes:
        far = distances(g.out, s, high)
        paths = [[s]]
        while paths:
            longer = []
            for p in paths:
                if low <= len(p) - 1 and len(p) > 1:
                    found.add(tuple(sorted(p)))
                if len(p) - 1 < high:
                    longer += [p + [v] for v in g.out[p[-1]] if far.get(v) == len(p)]
            paths = longer
    return [list(p) for p in sorted(found, key=lambda p: (len(p), p))]


def _draw(seed: int, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{what}".encode(), digest_size=8).digest(), "big")


def spine(g: Graph, radius: int, seed: int) -> list[list[int]]:
    """A longest shortest path, chosen by the seed among all, widened by ``radius``."""
    best: list[tuple[int, ...]] = []
    for s in g.nodes:
        before: dict[int, int | None] = {s: None}
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for v in sorted(g.out[u]):
                if v not in before:
                    before[v] = u
                    queue.append(v)
        for t in before:
            p, at = [], t
            while at is not None:
                p.append(at)
                at = before[at]
            if not best or len(p) > len(best[0]):
                best = []
            if not best or len(p) == len(best[0]):
                best.append(tuple(reversed(p)))
    if not best:
        return []
    line = min(best, key=lambda p: (_draw(seed, str(p)), p))
    return [sorted({v for n in line for v in distances(g.out, n, radius)})]


def connected_subsets(g: Graph, high: int) -> Iterator[tuple[int, ...]]:
    """Every connected node set of ``high`` nodes at most, once each, without any being held.

    A set is grown from its smallest node; a node may join it if no node before the newest one was its neighbour, so
    there's one way only to reach a set.
    """
    for root in g.nodes:
        stack = [((root,), sorted(v for v in g.near[root] if v > root), {root} | g.near[root])]
        while stack:
            own, may, seen = stack.pop()
            yield own
            if len(own) < high:
                for i, v in enumerate(may):
                    fresh = [w for w in g.near[v] if w > root and w not in seen]
                    stack.append(((*own, v), may[i + 1:] + fresh, seen | g.near[v]))


def graphlets(g: Graph, radius: int, low: int, high: int) -> Iterator[list[int]]:
    """The connected node sets of low to high nodes that lie within a radius of some node, one by one."""
    balls = [frozenset(distances(g.out, n, radius)) for n in g.nodes]
    by_node = defaultdict(list)
    for b in balls:
        for n in b:
            by_node[n].append(b)
    for own in connected_subsets(g, high):
        if low <= len(own) and any(b.issuperset(own) for b in by_node[own[0]]):
            yield sorted(own)


def cliques(g: Graph, low: int, high: int) -> Iterator[list[int]]:
    """All cliques of low to high nodes, one by one; each is grown by the common neighbours beyond its largest node."""
    ahead = {n: {v for v in g.near[n] if v > n} for n in g.nodes}
    stack = [([n], ahead[n]) for n in reversed(g.nodes)]
    while stack:
        own, may = stack.pop()
        if len(own) >= low:
            yield own
        if len(own) < high:
            stack += [([*own, v], may & ahead[v]) for v in may]


def betweenness(g: Graph) -> list[tuple[float, int]]:
    """(score, node), best first, by accumulating dependencies from every source; equal scores by node id."""
    score = dict.fromkeys(g.nodes, 0.0)
    for s in g.nodes:
        count, far, before, order = {s: 1.0}, {s: 0}, defaultdict(list), []
        queue = deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in sorted(g.out[u]):
                if v not in far:
                    far[v], count[v] = far[u] + 1, 0.0
                    queue.append(v)
                if far[v] == far[u] + 1:
                    count[v] += count[u]
                    before[v].append(u)
        owed = defaultdict(float)
        for v in reversed(order):
            for u in before[v]:
                owed[u] += count[u] / count[v] * (1 + owed[v])
            if v != s:
                score[v] += owed[v]
    return sorted(((round(x, 9), n) for n, x in score.items()), key=lambda p: (-p[0], p[1]))


def central(g: Graph, k: int, least: bool) -> list[list[int]]:
    ranked = betweenness(g)
    if least:
        ranked = sorted(ranked, key=lambda p: (p[0], p[1]))
    return [sorted(n for _, n in ranked[:k])] if ranked else []


def central_runs(g: Graph, k: int) -> list[list[int]]:
    if k <= 0:
        raise ValueError("number_of_nodes must be positive")
    ranked = [n for _, n in betweenness(g)]
    return [sorted(ranked[i:i + k]) for i in range(0, len(ranked), k)]


def hop_windows(g: Graph, hops: int) -> list[list[int]]:
    if hops <= 0:
        raise ValueError("n_hops must be positive")
    seen: set[int] = set()
    out = []
    for _, anchor in betweenness(g):
        if anchor not in seen:
            far = distances(g.out, anchor)
            seen |= far.keys()
            for start in range(0, max(far.values()) + 1, hops):
                out += components(g.part(n for n, d in far.items() if start <= d <= start + hops))
    return out


def shortest_path_unions(g: Graph, low: int, high: int) -> Iterator[list[int]]:
    far = {n: distances(g.out, n, high) for n in g.nodes}
    for u, v in combinations(g.nodes, 2):
        d = far[u].get(v)
        if d is not None and low <= d <= high:
            part = sorted(w for w, x in far[u].items() if w in far[v] and x + far[v][w] == d)
            if len(part) > 1:
                yield part


def random_parts(g: Graph, samples: int, seed: int) -> list[list[int]]:
    out = []
    for i in range(samples):
        if g.nodes:
            rng = random.Random(_draw(seed, f"{i}:{g.nodes}"))
            part = g.part(rng.choices(g.nodes, k=len(g.nodes)))
            out.append(max(components(part), key=lambda c: (len(c), [-n for n in c])))
    return out


def _improved(g: Graph, a: set[int]) -> tuple[int, set[int]]:
    """(edges cut, half): moves between two halves until a whole pass brings nothing (Fiduccia and Mattheyses).

    In a pass every node moves once: always the one of the best gain, from the larger half, or from either if they are
    equal. Gains may be negative on the way; the pass is rolled back to the best of its balanced states.
    """
    near = {n: [m for m in g.near[n] if m != n] for n in g.nodes}
    odd = len(g.nodes) % 2
    cut = sum(1 for n in a for m in near[n] if m not in a)
    while True:
        side = {n: n in a for n in g.nodes}
        gain = {n: sum(1 if side[m] != side[n] else -1 for m in near[n]) for n in g.nodes}
        heaps: dict[bool, list] = {True: [], False: []}
        for n in g.nodes:
            heaps[side[n]].append((-gain[n], n))
        for h in heaps.values():
            heapify(h)
        free, size, now, moved = set(g.nodes), len(a), cut, []
        best, kept = cut, 0
        while free:
            for h in heaps.values():  # entries of moved nodes and of older gains
                while h and (h[0][1] not in free or -h[0][0] != gain[h[0][1]]):
                    heappop(h)
            sides = [s for s, many in ((True, size), (False, len(g.nodes) - size)) if heaps[s] and 2 * many >= len(g.nodes) - odd]
            if not sides:
                break
            s = min(sides, key=lambda x: heaps[x][0])
            n = heappop(heaps[s])[1]
            free.discard(n)
            moved.append(n)
            now -= gain[n]
            size += -1 if s else 1
            side[n] = not s
            for m in near[n]:
                if m in free:
                    gain[m] += 2 if side[m] == s else -2
                    heappush(heaps[side[m]], (-gain[m], m))
            if abs(2 * size - len(g.nodes)) <= odd and now < best:
                best, kept = now, len(moved)
        if not kept:
            return cut, a
        a, cut = a.symmetric_difference(moved[:kept]), best


def bisections(g: Graph, seed: int, trials: int = 1) -> Iterator[tuple[int, set[int], set[int]]]:
    """(edges cut, half, half) of some seeded starts, each improved by moves; one start in two grows from a node."""
    half = len(g.nodes) // 2
    for trial in range(trials):
        order = sorted(g.nodes, key=lambda n: (_draw(seed + trial, str(n)), n))
        far = distances(g.near, order[0]) if order else {}
        grown = sorted(g.nodes, key=lambda n: far.get(n, len(far)))
        cut, a = min((_improved(g, set(x[:half])) for x in (order, grown)), key=lambda x: x[0])
        yield cut, a, set(g.nodes) - a


def bisect(g: Graph, seed: int, trials: int = 1) -> tuple[set[int], set[int]]:
    """Two halves with few edges between: the first best of the bisections."""
    return min(bisections(g, seed, trials), key=lambda x: x[0])[1:]


def split(g: Graph, parts: int, seed: int) -> list[list[int]]:
    """Components, the largest halved again and again until there are ``parts`` or nothing can be halved."""
    if not isinstance(parts, int) or parts < 1:
        raise ValueError("n_parts must be a whole number of at least 1")
    done, left = [], components(g)
    while left and len(done) + len(left) < parts:
        left.sort(key=lambda c: (len(c), [-n for n in c]))
        part = left.pop()
        if len(part) < 2:
            done.append(part)
            continue
        for half in bisect(g.part(part), seed):
            left += components(g.part(half))
    return sorted(done + left)


def boundary(g: Graph, part: Iterable[int]) -> int:
    """Nodes of a part that have a neighbour beyond it."""
    own = set(part)
    return sum(any(v not in own for v in g.near[n]) for n in own)


def low_cut(g: Graph, p: dict) -> list[list[int]]:
    """Split a graph where few edges are cut until parts are small: at a bridge or a pair of edges, else by halving.

    A halving is wanted if it cuts ``target_max_cut_edges`` at most, leaves ``target_max_boundary_nodes`` at most on
    either side, and the smaller side has ``balance_tolerance`` of the larger one's nodes. Where no trial is, the
    best one is taken for a part that is too large, or none without ``force_split_oversized``. With
    ``strict_max_boundary`` a part that still has too long a boundary falls apart into its edges.
    """
    accepted: list[list[int]] = []
    work = [(c, 0) for c in components(g)]
    seed = p["seed"] or 0
    while work:
        part, depth = work.pop()
        own = g.part(part)
        if len(part) <= max(1, p["max_part_size"]) or len(part) < 2 or depth >= p["max_depth"]:
            accepted.append(part)
            continue
        halves = _attached(own, p) if p["prefer_low_attachment_split"] else None
        if halves is None:
            halves = _halved(own, seed + depth, p)
        if len(halves) < 2:
            accepted.append(part)
            continue
        work += [(c, depth + 1) for c in halves]
    if p["strict_max_boundary"]:
        accepted = [x for c in accepted for x in ([c] if boundary(g, c) <= p["target_max_boundary_nodes"] else _edge_cover(g, c))]
    return [sorted(c) for c in sorted(_overlap(g, accepted, p), key=lambda c: sorted(c))]


def _halved(g: Graph, seed: int, p: dict) -> list[list[int]]:
    """The connected parts of the halving that comes nearest to its targets; just one part if none is good enough."""
    best = None
    for cut, a, b in bisections(g, seed, max(1, p["max_split_trials"])):
        halves = [c for h in (a, b) for c in components(g.part(h))]
        if not p["allow_small_parts"]:
            halves = _absorb(g, halves, p["min_part_size"])
        small, large = min(map(len, halves)), max(map(len, halves))
        misses = (
            max(0, cut - p["target_max_cut_edges"]) + max(0, max(boundary(g, c) for c in halves) - p["target_max_boundary_nodes"])
            + (small < p["balance_tolerance"] * large) + (small < p["min_part_size"] and not p["allow_small_parts"])
        )
        if best is None or (misses, cut) < best[:2]:
            best = (misses, cut, halves)
    return [g.nodes] if best[0] and not p["force_split_oversized"] else best[2]


def _edge_cover(g: Graph, part: list[int]) -> list[list[int]]:
    """The edges of a part, and its nodes without any."""
    own = set(part)
    arcs = [[u, v] for u, v in g.edges if u in own and v in own]
    alone = own - {n for e in arcs for n in e}
    return arcs + [[n] for n in sorted(alone)]


def _attached(g: Graph, p: dict) -> list[list[int]] | None:
    """The split into two sides of enough nodes that hang together by one edge, or else by two."""
    least, tried = p["low_attachment_min_component_size"], 0
    every = sorted({(min(e), max(e)) for e in g.edges})
    for many in range(1, p["low_attachment_max_edges"] + 1):
        best = None
        for cut in combinations(every, many) if many > 1 else ((e,) for e in sorted({(min(e), max(e)) for e in bridges(Graph(g.nodes, g.edges, False))})):
            tried += many > 1
            if tried > p["low_attachment_max_pair_trials"]:
                break
            sides = components(Graph(g.nodes, [e for e in g.edges if (min(e), max(e)) not in cut], False))
            if len(sides) == 2 and min(map(len, sides)) >= least:
                key = (abs(len(sides[0]) - len(sides[1])), sides)
                best = key if best is None else min(best, key)
        if best:
            return best[1]
    return None


def _absorb(g: Graph, parts: list[list[int]], least: int) -> list[list[int]]:
    parts = sorted(parts, key=len)
    while len(parts) > 2 and len(parts[0]) < least:
        small = parts.pop(0)
        touching = [q for q in parts if any(v in q for n in small for v in g.near[n])] or parts
        parts.remove(touching[0])
        parts = sorted([*parts, sorted(touching[0] + small)], key=len)
    return parts


def _overlap(g: Graph, parts: list[list[int]], p: dict) -> list[set[int]]:
    """Each part takes in up to ``min_overlap_nodes`` nodes from beyond its edges, most connected first."""
    out = []
    for c in parts:
        own, beyond = set(c), defaultdict(int)
        for n in c:
            for v in g.near[n]:
                if v not in own:
                    beyond[v] += 1
        out.append(own | set(sorted(beyond, key=lambda v: (-beyond[v], v))[: p["min_overlap_nodes"]]))
    return out


class Reach:
    """Distances between node sets up to ``high``, each found by one search that goes no farther."""

    def __init__(self, g: Graph, high: int):
        self.g, self.high, self.all_of = g, high, {}
        self.part = {n: i for i, c in enumerate(components(g)) for n in c}

    def whole(self, a: list[int], b: list[int]) -> bool:
        """Whether every node of b can be reached from every node of a, however far."""
        if not self.g.directed:
            return len({self.part.get(n, -1 - i) for i, n in enumerate([*a, *b])}) == 1
        for x in a:
            if x not in self.all_of:
                self.all_of[x] = set(distances(self.g.out, x)) if x in self.g.out else set()
        return all(y in self.all_of[x] for x in a for y in b)

    def only_part(self, a: list[int]) -> int | None:
        """The component that all of a's nodes lie in; None if there is no such one."""
        found = {self.part.get(n) for n in a}
        return found.pop() if len(found) == 1 else None

    def ball(self, a: list[int]) -> dict[int, int]:
        """The least distance from any node of a, of the nodes within ``high``."""
        found = {n: 0 for n in a if n in self.g.out}
        queue = deque(found)
        while queue:
            u = queue.popleft()
            if found[u] < self.high:
                for v in self.g.out[u]:
                    if v not in found:
                        found[v] = found[u] + 1
                        queue.append(v)
        return found


def close_sets(g: Graph, low: int, high: int, left: list[list[int]], right: list[list[int]], same: bool = False) -> list[set[int]]:
    """For each set of the left the numbers of those of the right that are wholly in reach at a least distance from low to high."""
    return list(sets_near(g, low, high, left, right, same))


def sets_near(g: Graph, low: int, high: int, left: list[list[int]], right: list[list[int]], same: bool = False) -> Iterator[set[int]]:
    """``close_sets`` one by one."""
    reach, holders = Reach(g, high), defaultdict(set)
    part = None if g.directed else [reach.only_part(b) for b in right]
    for j, b in enumerate(right):
        for y in b:
            holders[y].add(j)
    for i, a in enumerate(left):
        least: dict[int, int] = {}
        for y, d in reach.ball(a).items():
            for j in holders[y]:
                least[j] = min(d, least.get(j, d))
        if part is None:
            yield {j for j, d in least.items() if low <= d and not (same and i == j) and reach.whole(a, right[j])}
        else:
            own = reach.only_part(a)
            yield {j for j, d in least.items() if low <= d and not (same and i == j) and own is not None and part[j] == own}


def common_sets(left: list[list[int]], right: list[list[int]] | None, empty: bool) -> Iterator[tuple[int, ...]]:
    """The distinct common nodes of one set of each side, or of any two of the left; with ``empty`` also none, if some pair has none."""
    holders, seen, met, pairs = defaultdict(list), set(), 0, 0
    for j, b in enumerate(right or ()):
        for y in set(b):
            holders[y].append(j)
    for i, a in enumerate(left):
        own = sorted(set(a))
        common = defaultdict(list)
        for x in own:
            for j in holders.get(x, ()):
                common[j].append(x)
        pairs += i if right is None else len(right)
        met += len(common)
        for found in map(tuple, common.values()):
            if found not in seen:
                seen.add(found)
                yield found
        if right is None:
            for x in own:
                holders[x].append(i)
    if empty and met < pairs:
        yield ()


def combinations_within(g: Graph, sets: list[list[int]], count: tuple[int, int], distance: tuple[int, int]) -> Iterator[list[int]]:
    """Unions of every choice of k sets, each pair of which is at a distance in range, one by one."""
    ok = close_sets(g, *distance, sets, sets, True)

    def grow(chosen: list[int], start: int) -> Iterator[list[int]]:
        if count[0] <= len(chosen):
            yield sorted({n for i in chosen for n in sets[i]})
        if len(chosen) < count[1]:
            every = set.intersection(*(ok[i] for i in chosen))
            for j in sorted(x for x in every if x >= start):
                yield from grow([*chosen, j], j + 1)

    for i in range(len(sets)):
        yield from grow([i], i + 1)


# ---- canonical form ----------------------------------------------------------------------------


class _Canonical:
    """The search for a graph's least certificate.

    Nodes get colours that are refined by their neighbours' until stable; where several nodes of one colour are left, each in turn
    is singled out. Two prunings keep symmetric graphs small. A branch is left as soon as what its refinements looked like comes
    after the best branch's. And where a leaf equals the best one, the two orders are an automorphism: it unites nodes
    into orbits, of which one node each has to be tried wherever all nodes singled out before are fixed, and everything below the
    place where the two branches part is left at once.
    """

    def __init__(self, nodes: dict[int, str], edges: dict[tuple[int, int], str], directed: bool):
        self.labels, self.edges, self.directed = nodes, edges, directed
        codes = {x: k for k, x in enumerate(sorted(set(edges.values())))}
        self.near: dict[int, list[tuple[int, int]]] = {n: [] for n in nodes}  # (kind of edge and way, other end)
        for (u, v), x in edges.items():
            self.near[u].append((2 * codes[x], v))
            self.near[v].append((2 * codes[x] + directed, u))
        self.best: tuple | None = None  # (refinements, certificate), its nodes in order, those singled out
        self.moves: list[dict[int, int]] = []

    def refined(self, colors: dict[int, int]) -> tuple[dict[int, int], tuple]:
        """Stable colours, and what the way there looked like: the same for any numbering of the nodes."""
        count, trace = len(set(colors.values())), []
        while True:
            sign = {n: (colors[n], *sorted([k * len(self.labels) + colors[v] for k, v in near])) for n, near in self.near.items()}
            size = Counter(sign.values())
            rank, at = {}, 0
            for x in sorted(size):  # a colour is the number of nodes of smaller ones, so splitting one leaves the others' names
                rank[x] = at
                at += size[x]
            colors = {n: rank[x] for n, x in sign.items()}
            trace.append(tuple(sorted(size.items())))
            if len(rank) == count:
                return colors, tuple(trace[-1:])
            count = len(rank)

    def twins(self, members: list[int]) -> bool:
        """Whether any two of these nodes can be swapped with all others left in place."""
        own = set(members)
        first = None
        for n in members:
            beyond = sorted((k, v) for k, v in self.near[n] if v not in own)
            inside = sorted(k for k, v in self.near[n] if v in own)
            if len(set(inside)) > (2 if self.directed else 1) or (inside and len(inside) != (len(own) - 1) * len(set(inside))):
                return False
            if first is not None and (beyond, inside) != first:
                return False
            first = (beyond, inside)
        return True

    def orbits(self, fixed: list[int]) -> Callable[[int], int]:
        """The smallest node of each node's orbit under the known automorphisms that leave the fixed nodes in place."""
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for move in self.moves:
            if all(move[n] == n for n in fixed):
                for a, b in move.items():
                    a, b = find(a), find(b)
                    if a != b:
                        root[max(a, b)] = min(a, b)
        return find

    def leaf(self, colors: dict[int, int], traces: list[tuple], fixed: list[int]) -> int:
        order = sorted(colors, key=colors.get)
        place = {n: k for k, n in enumerate(order)}
        arcs = sorted((*((place[u], place[v]) if self.directed else sorted((place[u], place[v]))), x) for (u, v), x in self.edges.items())
        found = (traces[:], arcs)
        if self.best is None or found < self.best[0]:
            self.best = (found, order, fixed[:])
        elif found == self.best[0]:
            move = dict(zip(self.best[1], order, strict=True))
            self.moves.append(move)
            return next((k for k, (a, b) in enumerate(zip(fixed, self.best[2], strict=False)) if a != b), len(fixed))
        return len(fixed)

    def search(self, colors: dict[int, int], traces: list[tuple], fixed: list[int]) -> int:
        """Works a branch off; gives the depth down to which the search may go back at once."""
        colors, trace = self.refined(colors)
        traces.append(trace)
        depth = len(fixed)
        try:
            if self.best is not None and traces > self.best[0][0][:len(traces)]:
                return depth
            groups = defaultdict(list)
            for n, c in colors.items():
                groups[c].append(n)
            tied = min((c for c, g in groups.items() if len(g) > 1), default=None)
            if tied is None:
                return self.leaf(colors, traces, fixed)
            members = sorted(groups[tied])
            if self.twins(members):  # in any order: all at once
                place = {n: k for k, n in enumerate(members)}
                fixed += members
                back = self.search({n: c + place.get(n, 0) for n, c in colors.items()}, traces, fixed)
                del fixed[depth:]
                return min(back, depth)
            tried: list[int] = []
            for n in members:
                if tried:
                    orbit = self.orbits(fixed)
                    if orbit(n) in {orbit(m) for m in tried}:
                        continue
                tried.append(n)
                fixed.append(n)
                back = self.search({m: c + (c == tied and m != n) for m, c in colors.items()}, traces, fixed)
                fixed.pop()
                if back < depth:
                    return back
            return depth
        finally:
            traces.pop()

    def certificate(self) -> str:
        names = {x: k for k, x in enumerate(sorted(set(self.labels.values())))}
        self.search({n: names[x] for n, x in self.labels.items()}, [], [])
        (_, arcs), order, _ = self.best
        return f"{self.directed}|{([self.labels[n] for n in order], arcs)!r}"


def canonical(nodes: dict[int, str], edges: dict[tuple[int, int], str], directed: bool) -> str:
    """A certificate that two labelled graphs share if and only if they are isomorphic."""
    return _Canonical(nodes, edges, directed).certificate()


def bounded(text: str, nbits: int) -> int:
    """A hash from 2 to 2^nbits - 1; 0 and 1 are kept for other uses."""
    if nbits < 2:
        raise ValueError("nbits must be at least 2")
    low = int.from_bytes(hashlib.sha256(text.encode()).digest(), "big") & ((1 << nbits) - 1)
    return low % ((1 << nbits) - 2) + 2
