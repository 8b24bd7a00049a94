"""Plans as tables: operation, name, blocks read, records output, in pre-order."""

from __future__ import annotations

from marlstone.plans.nodes import Node

OPERATION_WIDTH = 60


def rows(plan: Node) -> list[tuple[int, int, str, str, int, int]]:
    """Number, depth, operation, name, reads, writes of each node."""
    found: list[tuple[int, int, str, str, int, int]] = []

    def walk(node: Node, depth: int) -> None:
        found.append((len(found) + 1, depth, node.operation, node.name, node.blocks, node.records))
        for child in node.children:
            walk(child, depth + 1)

    walk(plan, 0)
    return found


def text(plan: Node) -> str:
    lines = [f"{'#':<2} {'Operation':<{OPERATION_WIDTH}} {'Name':<20} {'Reads':>8} {'Writes':>8}", "-" * 102]
    for number, depth, operation, name, reads, writes in rows(plan):
        shown = "  " * depth + operation
        if len(shown) > OPERATION_WIDTH:
            shown = shown[: OPERATION_WIDTH - 3] + "..."
        lines.append(f"{number:>2} {shown:<{OPERATION_WIDTH}} {name:<20} {reads:>8} {writes:>8}")
    return "\n".join(lines)
