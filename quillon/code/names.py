"""Names, constants and imports in a syntax tree: what an expression is called and what it is worth."""

from __future__ import annotations

import ast
import codecs

UNKNOWN = object()
_MOST = 1 << 16


class Scope:
    """Names bound in a function or module, each with the expression last bound to it and its full name, if it has one."""

    def __init__(self, outer: Scope | None = None) -> None:
        self.outer, self.values, self.names = outer, {}, {}

    def value(self, name: str):
        s = self
        while s is not None:
            if name in s.values:
                return s.values[name]
            s = s.outer
        return None

    def full(self, name: str) -> str:
        s = self
        while s is not None:
            if name in s.names:
                return s.names[name]
            if name in s.values:
                return name
            s = s.outer
        return name

    def bind(self, name: str, value: ast.expr | None, full: str | None = None) -> None:
        self.values[name] = value
        self.names.pop(name, None)
        if full:
            self.names[name] = full


def imported(node: ast.Import | ast.ImportFrom) -> list[tuple[str, str]]:
    """(bound name, full name) of an import statement; a relative one keeps its leading dots."""
    if isinstance(node, ast.Import):
        return [(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in node.names]
    base = "." * node.level + (node.module or "")
    return [(a.asname or a.name, f"{base}.{a.name}" if base and not base.endswith(".") else f"{base}{a.name}") for a in node.names]


def full_name(node: ast.expr, scope: Scope, depth: int = 0) -> str | None:
    """The dotted name that an expression stands for, through imports, aliases and ``getattr`` of a constant."""
    if depth > 20:
        return None
    if isinstance(node, ast.Name):
        bound = scope.full(node.id)
        if bound != node.id:
            return bound
        value = scope.value(node.id)
        if isinstance(value, (ast.Name, ast.Attribute)) and not (isinstance(value, ast.Name) and value.id == node.id):
            return full_name(value, scope, depth + 1)
        if isinstance(value, ast.Call):
            return full_name(value, scope, depth + 1) or node.id
        return node.id
    if isinstance(node, ast.Attribute):
        base = full_name(node.value, scope, depth + 1)
        return f"{base}.{node.attr}" if base else None
    if isinstance(node, ast.Call):
        name = full_name(node.func, scope, depth + 1)
        if name == "__import__" and node.args:
            module = constant(node.args[0], scope)
            return module if isinstance(module, str) else None
        if name == "importlib.import_module" and node.args:
            module = constant(node.args[0], scope)
            return module if isinstance(module, str) else None
        if name == "getattr" and len(node.args) >= 2:
            base, attr = full_name(node.args[0], scope, depth + 1), constant(node.args[1], scope)
            return f"{base}.{attr}" if base and isinstance(attr, str) else None
        return name
    if isinstance(node, ast.Subscript):
        return full_name(node.value, scope, depth + 1)
    return None


def constant(node: ast.expr | None, scope: Scope, depth: int = 0):
    """What an expression is worth if that can be told: sums, formats, slices, decodings and names of constants. Else UNKNOWN."""
    if node is None or depth > 40:
        return UNKNOWN
    c = lambda n: constant(n, scope, depth + 1)
    try:
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            value = scope.value(node.id)
            return UNKNOWN if value is None or isinstance(value, ast.Name) and value.id == node.id else c(value)
        if isinstance(node, (ast.List, ast.Tuple)):
            items = [c(x) for x in node.elts]
            return UNKNOWN if any(x is UNKNOWN for x in items) else items
        if isinstance(node, ast.Dict):
            out = {}
            for k, v in zip(node.keys, node.values):
                value = c(v)
                if k is None:
                    if not isinstance(value, dict):
                        return UNKNOWN
                    out.update(value)
                else:
                    key = c(k)
                    if key is UNKNOWN or value is UNKNOWN:
                        return UNKNOWN
                    out[key] = value
            return out
        if isinstance(node, ast.JoinedStr):
            parts = [c(x.value) if isinstance(x, ast.FormattedValue) else c(x) for x in node.values]
            return UNKNOWN if any(x is UNKNOWN for x in parts) else "".join(map(str, parts))
        if isinstance(node, ast.UnaryOp):
            v = c(node.operand)
            if isinstance(v, (int, float)):
                return -v if isinstance(node.op, ast.USub) else +v if isinstance(node.op, ast.UAdd) else ~v if isinstance(node.op, ast.Invert) else not v
            return UNKNOWN
        if isinstance(node, ast.BinOp):
            a, b = c(node.left), c(node.right)
            if a is UNKNOWN or b is UNKNOWN:
                return UNKNOWN
            if isinstance(node.op, ast.Add) and type(a) is type(b) or isinstance(node.op, ast.Add) and isinstance(a, (int, float)) and isinstance(b, (int, float)):
                out = a + b
            elif isinstance(node.op, ast.Mod) and isinstance(a, (str, bytes)):
                out = a % (tuple(b) if isinstance(b, list) else b)
            elif isinstance(node.op, ast.Mult) and isinstance(a, (str, bytes)) and isinstance(b, int) and len(a) * b <= _MOST:
                out = a * b
            elif isinstance(a, (int, float)) and isinstance(b, (int, float)) and isinstance(node.op, (ast.Sub, ast.Mult, ast.BitXor)):
                out = a - b if isinstance(node.op, ast.Sub) else a * b if isinstance(node.op, ast.Mult) else a ^ b
            else:
                return UNKNOWN
            return out if not isinstance(out, (str, bytes)) or len(out) <= _MOST else UNKNOWN
        if isinstance(node, ast.Subscript):
            v = c(node.value)
            if v is UNKNOWN:
                return UNKNOWN
            if isinstance(node.slice, ast.Slice):
                edges = [None if x is None else c(x) for x in (node.slice.lower, node.slice.upper, node.slice.step)]
                return UNKNOWN if any(x is UNKNOWN for x in edges) else v[slice(*edges)]
            k = c(node.slice)
            return UNKNOWN if k is UNKNOWN else v[k]
        if isinstance(node, ast.Call):
            args = [c(x) for x in node.args]
            if any(x is UNKNOWN for x in args):
                return UNKNOWN
            if isinstance(node.func, ast.Attribute):
                v = c(node.func.value)
                if v is not UNKNOWN and isinstance(v, (str, bytes)):
                    if node.func.attr == "decode":
                        return codecs.decode(v, args[0] if args else "utf-8")
                    if node.func.attr in ("replace", "lower", "upper", "strip", "join", "format", "encode"):
                        return getattr(v, node.func.attr)(*args)
            name = full_name(node.func, scope)
            if name in ("ord", "chr", "str", "bytes", "len") and len(args) == 1:
                return {"ord": ord, "chr": chr, "str": str, "bytes": bytes, "len": len}[name](args[0])
            if name in ("base64.b64decode", "bytes.fromhex", "codecs.decode", "binascii.unhexlify"):
                import base64
                import binascii

                return {"base64.b64decode": base64.b64decode, "bytes.fromhex": bytes.fromhex, "codecs.decode": codecs.decode, "binascii.unhexlify": binascii.unhexlify}[name](*args)
    except Exception:  # what the analysed program computes may fail in any way; its value is then not known
        return UNKNOWN
    return UNKNOWN
