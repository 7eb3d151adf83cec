"""pq-grams of syntax trees: stems of p ancestors with windows of q children, to compare sources by structure."""

from __future__ import annotations

import ast
from collections import Counter


def label(node: ast.AST) -> str:
    """The kind of a node, with what tells nodes of a kind apart whatever its names are."""
    kind = type(node).__name__
    if isinstance(node, (ast.BinOp, ast.UnaryOp, ast.AugAssign)):
        return f"{kind}:{type(node.op).__name__}"
    if isinstance(node, ast.Constant):
        return f"{kind}:{type(node.value).__name__}"
    if isinstance(node, ast.Call):
        return f"{kind}:{len(node.args)}"
    return kind


def pq_grams(tree: ast.AST, p: int = 2, q: int = 3) -> Counter:
    """How often each pq-gram occurs; places beyond the tree are ``*``. Contexts of names aren't nodes."""
    out: Counter = Counter()
    todo = [(tree, ("*",) * p)]
    while todo:
        node, stem = todo.pop()
        stem = (*stem[1:], label(node))
        kids = [k for k in ast.iter_child_nodes(node) if not isinstance(k, (ast.expr_context, ast.operator, ast.unaryop))]
        if not kids:
            out[stem + ("*",) * q] += 1
            continue
        row = [*("*",) * (q - 1), *map(label, kids), *("*",) * (q - 1)]
        for i in range(len(row) - q + 1):
            out[(*stem, *row[i : i + q])] += 1
        todo += [(k, stem) for k in kids]
    return out


def distance(a: Counter, b: Counter) -> float:
    """0 for equal bags of pq-grams, 1 for ones that share nothing."""
    total = sum(a.values()) + sum(b.values())
    return 1 - 2 * sum((a & b).values()) / total if total else 0.0
