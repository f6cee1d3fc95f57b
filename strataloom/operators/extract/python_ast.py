"""Python sources by the standard parser; node kinds are named as a concrete syntax tree would name them."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize

_NESTING = {"if_statement", "for_statement", "while_statement", "try_statement", "with_statement", "function_definition", "class_definition", "lambda"}
_KINDS = {
    ast.For: "for_statement", ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.ExceptHandler: "except_clause", ast.ListComp: "list_comprehension", ast.IfExp: "conditional_expression", ast.Assert: "assert_statement", ast.Try: "try_statement",
    ast.TryStar: "try_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement", ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition", ast.Lambda: "lambda", ast.Raise: "raise_statement",
}
_ABSTRACT = {"ABC", "ABCMeta", "Protocol"}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree_nodes(root: ast.AST) -> list[tuple[str, int, int, bool, bool]]:
    """(kind, line, nest level, ignored, logical) of the structural nodes from root down."""
    out = []

    def emit(kind: str, node: ast.AST, level: int, ignored: bool, logical: bool = False) -> int:
        out.append((kind, getattr(node, "lineno", root.lineno), level, ignored, logical))
        return level + (kind in _NESTING)

    def block(nodes: list, level: int, ignored: bool) -> None:
        for n in nodes:
            walk(n, level, ignored)

    def branches(node: ast.If, level: int, ignored: bool) -> None:
        walk(node.test, level, ignored)
        block(node.body, level, ignored)
        rest = node.orelse
        if len(rest) == 1 and isinstance(rest[0], ast.If) and rest[0].col_offset == node.col_offset:
            emit("elif_clause", rest[0], level, ignored)
            branches(rest[0], level, ignored)
        elif rest:
            emit("else_clause", rest[0], level, ignored)
            block(rest, level, ignored)

    def walk(node: ast.AST, level: int, ignored: bool) -> None:
        if isinstance(node, ast.If):
            branches(node, emit("if_statement", node, level, ignored), ignored)
            return
        if isinstance(node, ast.BoolOp):
            for _ in node.values[1:]:
                emit("boolean_operator", node, level, ignored, True)
            block(node.values, level, ignored)
            return
        if isinstance(node, ast.Raise):
            ignored = True
        inner = emit(_KINDS[type(node)], node, level, ignored) if type(node) in _KINDS else level
        for name, value in ast.iter_fields(node):
            items = [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, ast.AST)]
            if not items:
                continue
            if name == "orelse" and isinstance(node, (ast.For, ast.AsyncFor, ast.While, ast.Try)):
                emit("else_clause", items[0], inner, ignored)
            gone = name == "finalbody"
            if gone:
                emit("finally_clause", items[0], inner, True)
            block(items, inner, ignored or gone)

    walk(root, 0, False)
    return out


def _tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of the tokens that count as operators or operands."""
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(source).readline):
            if t.type == tokenize.NAME:
                if t.string in ("True", "False", "None"):
                    kind = t.string.lower()
                else:
                    kind = t.string if keyword.iskeyword(t.string) else "identifier"
            elif t.type == tokenize.OP:
                kind = t.string
            elif t.type == tokenize.NUMBER:
                kind = "float" if any(c in t.string for c in ".eEjJ") and not t.string.lower().startswith("0x") else "integer"
            elif t.type in (tokenize.STRING, getattr(tokenize, "FSTRING_MIDDLE", -1)):
                kind = "string"
            else:
                continue
            out.append((kind, t.string, t.start[0]))
    except (tokenize.TokenError, IndentationError):
        pass
    return out


def parse(source: str) -> dict:
    tree = ast.parse(source)
    tokens = _tokens(source)
    functions, nodes, imports, calls, types = [], [], [], [], []

    def visit(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFS):
                seq = len(functions)
                end = child.end_lineno or child.lineno
                functions.append({"name": child.name, "start_line": child.lineno, "end_line": end, "parameter_count": 0, "is_method": in_class, "visibility": "private", "seq": seq})
                nodes.extend({"seq": seq, "kind": k, "text": "", "line": line, "nest_level": level, "ignored": ignored, "logical": logical} for k, line, level, ignored, logical in _tree_nodes(child))
                nodes.extend({"seq": seq, "kind": k, "text": t, "line": line, "nest_level": 0, "ignored": False, "logical": False} for k, t, line in tokens if child.lineno <= line <= end)
            elif isinstance(child, ast.ClassDef):
                bases = [b for b in [*child.bases, *(k.value for k in child.keywords)]]
                names = {b.attr if isinstance(b, ast.Attribute) else getattr(b.value if isinstance(b, ast.Subscript) else b, "id", "") for b in bases}
                marked = any("abstractmethod" in ast.dump(d) for f in child.body if isinstance(f, _DEFS) for d in f.decorator_list)
                types.append({"name": child.name, "is_abstract": bool(names & _ABSTRACT) or marked})
            elif isinstance(child, ast.Call):
                target = child.func
                name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
                if name:
                    calls.append({"callee": name, "line": child.lineno})
            elif isinstance(child, ast.Import):
                imports.extend({"import_path": a.name, "symbols": [], "is_wildcard": False} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                wild = any(a.name == "*" for a in child.names)
                imports.append({"import_path": "." * child.level + (child.module or ""), "symbols": [] if wild else [a.name for a in child.names], "is_wildcard": wild})
            visit(child, isinstance(child, ast.ClassDef))

    visit(tree, False)
    return {"functions": functions, "imports": imports, "calls": calls, "types": types, "nodes": nodes}
