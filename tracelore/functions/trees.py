"""Features, sizes and renderings of term trees.

A tree is nested tuples (kind, symbol, children), children being (role, tree) pairs in order. Kinds with a symbol are atoms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

# How atoms are written, by kind; the prefix stands before the symbol, None writes the prefix alone.
ATOMS = {"Rel": ("R", False), "Evar": ("E", False), "Construct": ("", True), "Ind": ("", True), "Const": ("", True), "Var": ("$", True), "Int": ("i", True), "Float": ("f", True)}
# Kinds that show neither as atom nor as structure.
SILENT = {"Sort", "Meta"}
#: Depth up to which an atom shows in the structure, and the depth at which every node ends a branch of it.
SHOWN, CUT = 2, 3
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

Tree = tuple[str, str | None, list]


def atom(kind: str, symbol: str | None) -> str:
    prefix, named = ATOMS[kind]
    return prefix + (symbol or "") if named else prefix


class Walk:
    """One pass over a tree that gathers pairs of neighbouring atoms, paths from the root, and the shape.

    Along an application's spine an atom is paired with the one before it: every argument starts after the head, a projection
    goes on after its constant, and a cast's type stands alone. Other constructions start afresh for each child and after it.
    Generators stand for calls, so a tree may be of any depth; paths are as long as it is deep.
    """

    def __init__(self, length: int = 2):
        self.length = length
        self.semantic: Counter[str] = Counter()
        self.vertical: Counter[str] = Counter()
        self.shape: list[str] = []

    def emit(self, token: str, before: tuple[str, ...]) -> tuple[str, ...]:
        run = token
        self.semantic[run] += 1
        for earlier in before[: self.length - 1]:
            run = f"{run}-{earlier}"
            self.semantic[run] += 1
        return (token, *before)[: self.length - 1]

    def visit(self, tree: Tree, role: str, depth: int, before: tuple[str, ...], path: tuple[str, ...]):
        """Returns the atoms before whatever follows, and the path as the walk leaves it."""
        stack, value = [self.step(tree, role, depth, before, path)], None
        while stack:
            try:
                inner = stack[-1].send(value)
            except StopIteration as e:
                stack.pop()
                value = e.value
            else:
                stack.append(inner)
                value = None
        return value

    def step(self, tree, role, depth, before, path):
        kind, symbol, children = tree
        if kind in ATOMS:
            token = atom(kind, symbol)
            if len(path) != 1:
                self.vertical["-".join([*path, f"{token}:{role}"])] += 1
            before = self.emit(token, before)
            if depth <= SHOWN:
                self.shape.append("X")
        else:
            path = (*path, role)
            if kind not in SILENT:
                before, path = yield self.inside(kind, symbol, children, depth, before, path)
        if depth == CUT:
            self.shape.append("X")
        return before, path

    def inside(self, kind, symbol, children, depth, before, path):
        here = path
        if kind == "Proj":
            before = self.emit(symbol or "", before)
        self.shape += ["(", kind]
        if kind == "App":
            (role, head), *arguments = children
            after, left = yield self.step(head, role, depth + 1, before, here)
            self.shape.append(str(len(arguments)))
            for role, argument in arguments:
                _, left = yield self.step(argument, role, depth + 1, after, here)
            before, path = (), left
        elif kind == "Cast":
            by_role = dict(children)
            _, left = yield self.step(by_role["CastType"], "CastType", depth + 1, (), here)
            before, path = yield self.step(by_role["CastTerm"], "CastTerm", depth + 1, before, left)
        elif kind == "Proj":
            before, path = yield self.step(children[0][1], children[0][0], depth + 1, before, here)
        else:
            for role, child in children:
                _, path = yield self.step(child, role, depth + 1, (), here)
            before = ()
        self.shape.append(")")
        return before, path


def simple_features(tree: Tree) -> list[str]:
    """Distinct atoms and pairs, sorted."""
    w = Walk()
    w.visit(tree, "Root", 0, (), ())
    return sorted(w.semantic)


def complex_features(tree: Tree) -> list[tuple[str, str, int]]:
    """(kind, token, count) of semantic pairs, vertical paths and the one structural shape."""
    w = Walk()
    w.visit(tree, "Root", 0, (), ())
    return [*(("Seman", k, n) for k, n in sorted(w.semantic.items())), *(("Verti", k, n) for k, n in sorted(w.vertical.items())), ("Struct", "-".join(w.shape), 1)]


def nodes(tree: Tree) -> Iterator[tuple[int, int | None, int, str, str, str | None]]:
    """(node, parent, ordinal, role, kind, symbol) in preorder, the root being node 0."""
    stack: list[tuple[Tree, int | None, int, str]] = [(tree, None, 0, "Root")]
    n = 0
    while stack:
        (kind, symbol, children), parent, at, role = stack.pop()
        yield n, parent, at, role, kind, symbol
        stack += [(child, n, i, r) for i, (r, child) in reversed(list(enumerate(children)))]
        n += 1


def scopes(tree: Tree) -> list[tuple[int, int]]:
    """(node, last node of its subtree) in preorder."""
    parents = [parent for _, parent, *_ in nodes(tree)]
    last = list(range(len(parents)))
    for n in range(len(parents) - 1, 0, -1):
        last[parents[n]] = max(last[parents[n]], last[n])
    return list(enumerate(last))


def size(tree: Tree) -> int:
    """Every edge adds one to the nodes."""
    return 2 * sum(1 for _ in nodes(tree)) - 1


def sexpr(tree: Tree) -> str:
    out: list[str] = []
    stack: list[Tree | None] = [tree]
    while stack:
        here = stack.pop()
        if here is None:
            out.append(")")
            continue
        kind, symbol, children = here
        out.append(f"{' ' * (len(out) > 0)}({kind}{'' if symbol is None else ' ' + symbol}")
        stack += [None, *(c for _, c in reversed(children))]
    return "".join(out)


_TAG = re.compile(r"<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>|<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>", re.S)
_LINK = re.compile(r"""\b(?:href|src)\s*=\s*["']([^"']*)["']""")


def from_html(html: str | None) -> Tree:
    """A page as a term: an element applies its tag to its children; a link's target is a variable. Text is left out.

    A closing tag closes the nearest open element of its name, or nothing. Nesting has no limit. Scripts, styles and comments are skipped. A null or
    empty page is the constant page.
    """
    root: list = ["page", []]
    open_: list[list] = [root]
    names: Counter[str] = Counter()
    made = [root]
    for m in _TAG.finditer(html or ""):
        if m.group(3) is None:
            continue
        tag = m.group(3).lower()
        if m.group(2):
            while names[tag]:
                last = open_.pop()[0]
                names[last] -= 1
                if last == tag:
                    break
            continue
        element = [tag, []]
        if link := _LINK.search(m.group(4)):
            element[1].append(("Var", unescape(link.group(1)), []))
        open_[-1][1].append(element)
        made.append(element)
        if tag not in VOID and not m.group(4).endswith("/"):
            open_.append(element)
            names[tag] += 1

    terms: dict[int, Tree] = {}
    for e in reversed(made):  # children come after their element
        head = ("Const", e[0], [])
        inside = [("AppArg", c if isinstance(c, tuple) else terms.pop(id(c))) for c in e[1]]
        terms[id(e)] = ("App", None, [("AppFun", head), *inside]) if inside else head
    return terms[id(root)]
