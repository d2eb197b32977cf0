"""Statement productions as reductions: one run over the token classes of a file tells whether its grammar permits them.

A grammar (``grammars``) is cut at its brackets: a bracketed group is a word of its own, and to the text around it one symbol
that says which of the grammar's groups it can be (a set: "(x)" may be arguments, parameters or a plain bracket). So each nesting
depth is reduced by itself, from the inside to the outside. What a depth may hold is recognized by following all readings at once;
sets of readings, and the step from one to the next by a class, are kept, so that later texts cost one lookup a class.

Rules must not be left-recursive. Other recursion is exact: a reading remembers where it has to go on.
"""

from __future__ import annotations

from functools import cache

from srclake.llm.grammars import GRAMMARS, SOFT_END, expand, parse

_CLOSER = {"(": ")", "[": "]", "{": "}"}
#: Sets of readings, and points in them, kept before all are given up and found anew; bounds memory, not what is read.
KEPT, POINTS = 100_000, 1_000_000


class _Readings(dict):
    """Class or group -> the readings after it; found when first asked for."""

    __slots__ = ("of", "items", "mask")

    def __init__(self, of: "Reductions", items: frozenset[int]):
        self.of, self.items, self.mask = of, items, None

    def __missing__(self, c):
        found = self.of.after(self.items, c)
        self[c] = found
        return found


class Reductions:
    def __init__(self, rules: dict[str, list[list[str]]], soft_end: str = ""):
        self.soft_end = soft_end
        self.nodes: list[dict] = []  # of each: (symbol, repeats, may be left out) -> next node; None: a rule may end here
        self.starts: dict[str, int] = {}
        self.roles: dict[tuple, int] = {}  # bracketed group of the grammar -> its number
        self.role_starts: list[tuple[str, int]] = []
        for rule, alternatives in rules.items():
            self.starts[rule] = self._tree([self._fold(seq) for seq in alternatives])
        self.loops: dict[tuple, int] = {}
        self.file = 1 << len(self.role_starts)
        self._begin()

    def _begin(self) -> None:
        """Nothing is known yet but where texts begin."""
        self.ids: dict[tuple[int, int], int] = {}
        self.points: list[tuple[int, int]] = []  # (node, point to go on with; -1 - role where a group ends)
        self.known: dict[int, tuple] = {}
        self.sets: dict[frozenset[int], _Readings] = {}
        self.first = frozenset({self._point(self.starts["file"], -1 - len(self.role_starts))})
        self.groups = {b: frozenset(self._point(n, -1 - r) for r, (o, n) in enumerate(self.role_starts) if o == b) for b in _CLOSER}

    def _fold(self, seq: list[str]) -> list:
        stack: list[list] = [[]]
        for s in seq:
            if s in _CLOSER:
                stack.append([s])
            elif s in (")", "]", "}"):
                group = tuple(stack.pop())
                if group not in self.roles:
                    self.roles[group] = len(self.role_starts)
                    self.role_starts.append((group[0], -1))
                    self.role_starts[self.roles[group]] = (group[0], self._tree([list(group[1:])]))
                stack[-1].append(self.roles[group])
            else:
                stack[-1].append(s)
        return stack[0]

    def _tree(self, alternatives: list[list]) -> int:
        """Alternatives that begin alike share their beginning, so that one reading stands for them all."""
        root = len(self.nodes)
        self.nodes.append({})
        for seq in alternatives:
            at = root
            for s in seq:
                bare = s[:-1] if isinstance(s, str) and len(s) > 1 and s[-1] in "*?" else s
                edge = (bare, bare != s and s[-1] == "*", bare != s)
                if edge not in self.nodes[at]:
                    self.nodes[at][edge] = len(self.nodes)
                    self.nodes.append({})
                at = self.nodes[at][edge]
            self.nodes[at][None] = -1
        return root

    def _point(self, node: int, then: int) -> int:
        key = (node, then)
        if key not in self.ids:
            self.ids[key] = len(self.points)
            self.points.append(key)
        return self.ids[key]

    def _from(self, point: int) -> tuple[dict, dict, int]:
        """(class -> points, group -> points, roles that may end here) of one point."""
        if point in self.known:
            return self.known[point]
        tokens: dict[str, set[int]] = {}
        groups: dict[int, set[int]] = {}
        ends, seen, todo = 0, {point}, [point]

        def go(p: int) -> None:
            if p not in seen:
                seen.add(p)
                todo.append(p)

        while todo:
            p = todo.pop()
            node, then = self.points[p]
            for edge, following in self.nodes[node].items():
                if edge is None:
                    if then < 0:
                        ends |= 1 << (-1 - then)
                    else:
                        go(then)
                    continue
                symbol, repeats, optional = edge
                if optional:
                    go(self._point(following, then))
                # What may be repeated leads to a node of its own, so that nothing else can follow instead.
                after = self._loop(edge, following) if repeats else following
                if isinstance(symbol, int):
                    groups.setdefault(symbol, set()).add(self._point(after, then))
                elif len(symbol) == 1:
                    tokens.setdefault(symbol, set()).add(self._point(after, then))
                else:
                    back = then if self.nodes[after].keys() == {None} else self._point(after, then)
                    go(self._point(self.starts[symbol], back))
        self.known[point] = tokens, groups, ends
        return self.known[point]

    def _loop(self, edge: tuple, following: int) -> int:
        """The node after one of a repeated symbol: another one, or what follows."""
        key = (edge, following)
        if key not in self.loops:
            self.loops[key] = len(self.nodes)
            self.nodes.append({edge: following})
        return self.loops[key]

    def readings(self, items: frozenset[int]) -> _Readings:
        if items not in self.sets:
            self.sets[items] = _Readings(self, items)
        return self.sets[items]

    def after(self, items: frozenset[int], c) -> _Readings:
        found: set[int] = set()
        if c == "\n":  # a line end that may end a statement
            found |= items
            c = ";"
        elif c == "$" and c in self.soft_end:
            items = items | self.after(items, ";").items
        for p in items:
            tokens, groups, _ = self._from(p)
            if isinstance(c, int):
                for r, points in groups.items():
                    if c >> r & 1:
                        found |= points
            else:
                found.update(tokens.get(c, ()))
        return self.readings(frozenset(found))

    def mask(self, s: _Readings, closer: str) -> int:
        """Which groups a text may be that ends here."""
        if s.mask is None:
            ends = 0
            for x in (s, s[";"]) if closer in self.soft_end else (s,):
                for p in x.items:
                    ends |= self._from(p)[2]
            s.mask = ends
        return s.mask

    def broken(self, classes: str) -> int | None:
        """Where the classes stop being a text of the language; None if they never do, or if brackets do not match."""
        if len(self.sets) > KEPT or len(self.points) > POINTS:
            self._begin()
        s = self.readings(self.first)
        groups = {b: self.readings(items) for b, items in self.groups.items()}
        stack: list[tuple[_Readings, str]] = []
        for k, c in enumerate(classes):
            if c in "([{":
                stack.append((s, _CLOSER[c]))
                s = groups[c]
                continue
            if c in ")]}":
                if not stack or stack[-1][1] != c:
                    return None
                kind = self.mask(s, c)
                if not kind:
                    return k
                s = stack.pop()[0][kind]
            else:
                s = s[c]
            if not s.items:
                return k
        if stack:
            return None
        return None if self.mask(s, "$") & self.file else len(classes)


@cache
def reductions(language: str) -> Reductions:
    return Reductions(expand(parse(GRAMMARS[language])), SOFT_END.get(language, ""))
