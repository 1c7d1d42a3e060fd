"""A small regular-expression parser on the driver: its tree, and the literals that every match must contain.

Grammar: union ``|``, concatenation, ``*``, parentheses and single characters; anything else that has a meaning in common dialects makes the
pattern opaque: it is still run by the engine, but prunes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

SPECIAL = set(".+?[]{}^$\\")


@dataclass
class Node:
    kind: str  # char, any, concat, union, star, empty
    text: str = ""
    children: list[Node] = field(default_factory=list)

    def as_dict(self) -> dict:
        out: dict = {"kind": self.kind}
        if self.text:
            out["text"] = self.text
        if self.children:
            out["children"] = [c.as_dict() for c in self.children]
        return out


class Unsupported(ValueError):
    pass


def parse(pattern: str) -> Node:
    """The tree of a pattern; raises Unsupported for syntax outside the grammar and for unbalanced parentheses."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def union() -> Node:
        nonlocal at
        options = [concat()]
        while peek() == "|":
            at += 1
            options.append(concat())
        return options[0] if len(options) == 1 else Node("union", children=options)

    def concat() -> Node:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeat())
        return Node("empty") if not parts else parts[0] if len(parts) == 1 else Node("concat", children=parts)

    def repeat() -> Node:
        nonlocal at
        node = atom()
        while peek() == "*":
            at += 1
            node = Node("star", children=[node])
        return node

    def atom() -> Node:
        nonlocal at
        c = peek()
        if c == "(":
            at += 1
            node = union()
            if peek() != ")":
                raise Unsupported("unbalanced parenthesis")
            at += 1
            return node
        if not c or c in SPECIAL or c in "*|)":
            raise Unsupported(f"cannot parse {c!r} at {at}")
        at += 1
        return Node("char", c)

    tree = union()
    if at < len(pattern):
        raise Unsupported(f"unbalanced parenthesis at {at}")
    return tree


def required_literals(pattern: str) -> list[str]:
    """Literals that occur in every match, longest runs of plain characters on the top level of concatenation; [] if none is certain."""
    try:
        tree = parse(pattern)
    except Unsupported:
        return []
    out, run = [], ""
    for part in tree.children if tree.kind == "concat" else [tree]:
        if part.kind == "char":
            run += part.text
        elif part.kind == "concat":
            inner = "".join(c.text for c in part.children) if all(c.kind == "char" for c in part.children) else None
            if inner is not None:
                run += inner
                continue
            out.append(run)
            run = ""
        else:
            out.append(run)
            run = ""
    out.append(run)
    return [x for x in out if x]


def tree_json(pattern: str) -> str:
    return json.dumps(parse(pattern).as_dict())


def pretty(pattern: str) -> str:
    """The tree, one node a line, indented by depth."""
    lines = []

    def walk(node: Node, depth: int) -> None:
        lines.append("  " * depth + node.kind + (f" {node.text}" if node.text else ""))
        for c in node.children:
            walk(c, depth + 1)

    walk(parse(pattern), 0)
    return "\n".join(lines)
