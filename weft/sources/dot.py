"""Patterns as DOT. ``python -m weft.sources.dot`` reads a pattern and prints its drawing."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from ..errors import WeftError
from ..functions.pattern import Cluster, walk
from ..model import ANY, SRC, TGT, UND

_STYLE = {UND: "dir=none", SRC: "dir=forward", TGT: "dir=back", ANY: "dir=none, style=bold"}


def to_dot(clusters: Sequence[Cluster]) -> str:
    """A box for each cluster; negated parts are dashed, those of bans red."""
    lines = ["digraph pattern {"]
    anonymous: dict[int, str] = {}
    drawn: set[str] = set()

    def name(x) -> str:
        return f"n{x.id}" if x.id is not None else anonymous.setdefault(id(x), f"a{len(anonymous)}")

    edges = []
    for k, c in enumerate(clusters):
        color = "red" if c.decision == "ban" else "black"
        lines += [f"  subgraph cluster_{k} {{", f'    label="{c.decision}({c.morphism.name})"; color={color};']
        for near, link, far in walk(c.nodes):
            x = near if link is None else far
            if name(x) not in drawn:
                drawn.add(name(x))
                style = ", style=dashed" if x.negated else ""
                shape = "box" if x.role in "XTxtG" else "circle"
                label = ("" if x.id is None else str(x.id)) + ("*" if x.has_predicate else "")
                lines.append(f'    {name(x)} [label="{label}", shape={shape}{style}];')
            if link is not None:
                dashed = ", style=dashed" if link.edge.negated or near.negated or far.negated else ""
                edges.append(f"  {name(near)} -> {name(far)} [{_STYLE[link.slot]}{dashed}, color={color}];")
        lines.append("  }")
    return "\n".join([*lines, *edges, "}"]) + "\n"


def main() -> int:
    from .parser import parse

    try:
        sys.stdout.write(to_dot(parse(sys.stdin.read())))
    except (WeftError, TypeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
