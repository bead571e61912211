"""The network of languages: which converts to which, in the order in which conversions were added."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class LanguageNetwork:
    """A directed graph without weights. Neighbours and ties keep the order of insertion."""

    def __init__(self, edges: Iterable[tuple[str, str]] = ()):
        self._next: dict[str, dict[str, None]] = {}
        self._back: dict[str, dict[str, None]] = {}
        self.add_edges_from(edges)

    def add_node(self, u: str) -> None:
        self._next.setdefault(u, {})
        self._back.setdefault(u, {})

    def add_edge(self, u: str, v: str) -> None:
        self.add_node(u)
        self.add_node(v)
        self._next[u].setdefault(v)
        self._back[v].setdefault(u)

    def add_edges_from(self, edges: Iterable[tuple[str, str]]) -> None:
        for u, v in edges:
            self.add_edge(u, v)

    def update(self, edges: Iterable[tuple[str, str]] = (), nodes: Iterable[str] = ()) -> None:
        self.add_edges_from(edges)
        for u in nodes:
            self.add_node(u)

    def clear(self) -> None:
        self._next.clear()
        self._back.clear()

    @property
    def nodes(self) -> list[str]:
        return list(self._next)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return [(u, v) for u, out in self._next.items() for v in out]

    def __contains__(self, u) -> bool:
        return u in self._next

    def __len__(self) -> int:
        return len(self._next)

    def successors(self, u: str):
        return iter(self._next[u])

    def _reach(self, u: str, step: dict) -> set[str]:
        found, waiting = set(), deque(step[u])
        while waiting:
            v = waiting.popleft()
            if v not in found:
                found.add(v)
                waiting.extend(step[v])
        return found - {u}

    def descendants(self, u: str) -> set[str]:
        """What u leads to, without u itself."""
        return self._reach(u, self._next)

    def ancestors(self, u: str) -> set[str]:
        return self._reach(u, self._back)

    def has_path(self, u: str, v: str) -> bool:
        if v not in self._next:
            raise KeyError(v)
        return u == v or v in self.descendants(u)

    def shortest_path(self, u: str, v: str) -> list[str]:
        """A path with fewest steps; ValueError if there is none, KeyError for unknown languages."""
        if u not in self._next or v not in self._next:
            raise KeyError(u if u not in self._next else v)
        came, waiting = {u: None}, deque([u])
        while waiting and v not in came:
            at = waiting.popleft()
            for w in self._next[at]:
                if w not in came:
                    came[w] = at
                    waiting.append(w)
        if v not in came:
            raise ValueError(f"no path from {u} to {v}")
        path = [v]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        return path[::-1]


def node_link_data(g: LanguageNetwork) -> dict:
    return {"directed": True, "multigraph": False, "graph": {}, "nodes": [{"id": n} for n in g.nodes], "links": [{"source": u, "target": v} for u, v in g.edges]}


def node_link_graph(data: dict) -> LanguageNetwork:
    if not data.get("directed", True):
        raise ValueError("the graph must be directed")
    if data.get("multigraph"):
        raise ValueError("the graph must not have parallel edges")
    for key in ("nodes", "links"):
        if key not in data:
            raise ValueError(f"the graph has no {key}")
    g = LanguageNetwork()
    g.update(nodes=[n["id"] for n in data["nodes"]])
    g.add_edges_from((x["source"], x["target"]) for x in data["links"])
    return g


def echart_nodes(g: LanguageNetwork) -> list[dict]:
    """Nodes for a chart: size by how many languages they connect, between 2 and 20."""
    return [{"name": n, "symbolSize": max(2, min(20, len(g.ancestors(n)) + len(g.descendants(n)))), "id": n} for n in g.nodes]
