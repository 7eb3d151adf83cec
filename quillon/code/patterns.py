"""Patterns over sources, written as Python: ``requests.get(..., verify=False)``, ``flask.request.args``, ``import socket``.

A pattern is parsed; its last statement says what it hits. An import hits imports of the module and of what lies below it. A
call hits calls of that full name with just these positional constants, of which ``...`` lets any more follow, and with at least these
constant keywords; with ``...`` other keywords may stand too. A name hits wherever it, or what lies below it, is used or called. A constant hits equal constants.
Full names are those that imports and assignments resolve to.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from quillon.code.names import UNKNOWN, Scope, constant, full_name, imported


@dataclass(frozen=True)
class Pattern:
    kind: str
    name: str = ""
    args: tuple = ()
    more: bool = False
    keywords: tuple[tuple[str, object], ...] = ()

    def hits_call(self, name: str, values: list, keywords: dict) -> bool:
        """Whether a call of ``name`` with positional ``values`` and constant ``keywords`` (None where unknown) is one."""
        if self.kind == "name":
            return below(name, self.name)
        if self.kind != "call" or name != self.name:
            return False
        if len(values) < len(self.args) or not self.more and (len(values) > len(self.args) or len(keywords) > len(self.keywords)):
            return False
        return all(same(a, b) for a, b in zip(self.args, values)) and all(k in keywords and same(v, keywords[k]) for k, v in self.keywords)

    def hits_name(self, name: str) -> bool:
        return self.kind == "name" and below(name, self.name)

    def hits_import(self, module: str) -> bool:
        return self.kind == "import" and below(module, self.name)

    def hits_constant(self, value: object) -> bool:
        return self.kind == "constant" and same(self.args[0], value)


def same(wanted: object, found: object) -> bool:
    """Equal constants of one type; True isn't 1. Lists never match, a dict does if each of its entries does."""
    if wanted is Ellipsis:
        return True
    if isinstance(wanted, (list, tuple)):
        return False
    if isinstance(wanted, dict):
        return isinstance(found, dict) and all(k in found and same(v, found[k]) for k, v in wanted.items())
    return type(wanted) is type(found) and wanted == found


def below(name: str, top: str) -> bool:
    return name == top or name.startswith(top + ".")


def compiled(source: str) -> Pattern:
    """The pattern of a source text; ValueError if it is none."""
    try:
        last = ast.parse(source).body[-1]
    except (SyntaxError, IndexError) as e:
        raise ValueError(f"no pattern: {source!r}") from e
    if isinstance(last, ast.Import):
        return Pattern("import", last.names[0].name)
    if isinstance(last, ast.ImportFrom):
        return Pattern("import", ".".join(x for x in (last.module, last.names[0].name) if x))
    if not isinstance(last, ast.Expr):
        raise ValueError(f"no pattern: {source!r}")
    e, scope = last.value, Scope()
    if isinstance(e, ast.Constant):
        return Pattern("constant", args=(e.value,))
    if isinstance(e, ast.Call):
        args = [a.value if isinstance(a, ast.Constant) else constant(a, scope) for a in e.args]
        if any(a is UNKNOWN for a in args) or any(k.arg is None for k in e.keywords):
            raise ValueError(f"arguments must be constants: {source!r}")
        more = bool(args) and args[-1] is Ellipsis
        return Pattern("call", full_name(e.func, scope) or "", tuple(args[:-1] if more else args), more, tuple((k.arg, constant(k.value, scope)) for k in e.keywords))
    name = full_name(e, scope)
    if not name:
        raise ValueError(f"no pattern: {source!r}")
    return Pattern("name", name)


def matches(pattern: str | Pattern, source: str) -> list[int]:
    """The lines of ``source`` that a pattern hits, in order."""
    from quillon.code.analysis import Analysis

    p = compiled(pattern) if isinstance(pattern, str) else pattern
    a = Analysis("", source)
    if a.tree is None:
        return []
    lines = {c["line_no"] for c in a.calls.values() if p.hits_call(c["name"], c["values"], c["keywords"])}
    lines |= {line for name, line in a.names if p.hits_name(name)}
    for n in ast.walk(a.tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            full = [x for _, x in imported(n)] if isinstance(n, ast.ImportFrom) else [x.name for x in n.names]
            lines |= {n.lineno for x in full if p.hits_import(x)}
        elif isinstance(n, ast.Constant) and p.hits_constant(n.value):
            lines.add(n.lineno)
    return sorted(lines)
