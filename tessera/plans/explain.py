"""Plan trees as text."""

from __future__ import annotations

from .planner import Node


def render(node: Node, indent: str = "") -> str:
    """One operator a line, inputs indented below it, with estimated rows."""
    rows = "" if node.rows is None else f"  card:{node.rows}"
    lines = [f"{indent}{node.label}{rows}"]
    lines += [render(c, indent + "  ") for c in node.children]
    return "\n".join(lines)
