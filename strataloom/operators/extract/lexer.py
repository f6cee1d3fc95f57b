"""Rust and TypeScript sources by a small lexer and a walk over bracketed blocks.

There is no full grammar: constructs are recognised by their keywords and brackets, which is enough
for branches, nesting, calls, imports and the extent of functions.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)"
    r"|(?P<string>b?r#+\".*?\"#+|b?r?\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'(?=\s*[;,)\]}:+]))"
    r"|(?P<life>'[A-Za-z_]\w*)"
    r"|(?P<number>\d[\w]*(?:\.\d[\w]*)?)"
    r"|(?P<name>[A-Za-z_$][\w$]*!?(?=\()|[A-Za-z_$][\w$]*)"
    r"|(?P<op>\.\.\.|\.\.=|===|!==|\*\*=|=>|->|::|\?\.|\?\?|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|\.\.|\*\*|<<|[-+*/%=<>!&|^~?:;,.(){}\[\]#@])",
    re.DOTALL,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_RUST_WORDS = {"if", "else", "while", "for", "loop", "match", "return", "break", "continue", "let", "const", "fn", "async", "await", "use", "pub", "impl", "trait", "struct", "enum", "mod", "where", "move", "mut", "ref", "in", "as", "unsafe", "dyn", "type", "static", "crate", "super"}
_TS_WORDS = {"if", "else", "while", "for", "do", "switch", "case", "default", "return", "break", "continue", "let", "const", "var", "function", "async", "await", "try", "catch", "finally", "throw", "yield", "import", "from", "export", "class", "new", "typeof", "instanceof", "in", "of", "interface", "type", "extends", "implements", "void", "delete"}


def tokens_of(source: str) -> list[tuple[str, str, int]]:
    """(class, text, line), without comments."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "comment":
            out.append((m.lastgroup or "op", m.group(0), line))
    return out


def _matching(tokens: list[tuple[str, str, int]]) -> dict[int, int]:
    """Index of each opening bracket -> index of its partner."""
    stack, pairs = [], {}
    for i, (_, t, _) in enumerate(tokens):
        if t in _OPEN:
            stack.append(i)
        elif t in _CLOSE:
            while stack and _OPEN[tokens[stack[-1]][1]] != t:
                pairs[stack.pop()] = i
            if stack:
                pairs[stack.pop()] = i
    return pairs | {i: len(tokens) - 1 for i in stack}


class _Walk:
    """Emits structural nodes of tokens[a:b] with their nesting."""

    def __init__(self, tokens: list, pairs: dict[int, int], rust: bool):
        self.t, self.pairs, self.rust, self.out = tokens, pairs, rust, []

    def emit(self, kind: str, i: int, level: int, ignored: bool = False, logical: bool = False) -> None:
        self.out.append((kind, self.t[i][2], level, ignored, logical))

    def head_end(self, i: int, b: int) -> int:
        """The opening brace of the block that begins after a head at i."""
        while i < b:
            if self.t[i][1] == "{":
                return i
            i = self.pairs[i] + 1 if i in self.pairs else i + 1
        return b

    def branch(self, i: int, b: int, level: int) -> int:
        """An if at i, with its else; the index after it."""
        self.emit("if_expression" if self.rust else "if_statement", i, level)
        if self.rust:
            open_ = self.head_end(i + 1, b)
            self.walk(i + 1, open_, level + 1)
        else:
            open_ = self.pairs.get(i + 1, i + 1) + 1 if i + 1 < b and self.t[i + 1][1] == "(" else i + 1
            self.walk(i + 1, min(open_, b), level + 1)
        end = self.body(open_, b, level + 1)
        if end < b and self.t[end][1] == "else":
            self.emit("else_clause", end, level + 1)
            if end + 1 < b and self.t[end + 1][1] == "if":
                return self.branch(end + 1, b, level + 1)
            return self.body(end + 1, b, level + 1)
        return end

    def body(self, i: int, b: int, level: int) -> int:
        """A block, or one statement up to its semicolon."""
        if i >= b:
            return b
        if self.t[i][1] == "{":
            end = self.pairs.get(i, b)
            self.walk(i + 1, min(end, b), level)
            return min(end + 1, b)
        if self.t[i][1] == "if":
            return self.branch(i, b, level)
        j = i
        while j < b and self.t[j][1] not in (";", "}"):
            j = self.pairs[j] + 1 if j in self.pairs else j + 1
        self.walk(i, min(j, b), level)
        return min(j + 1, b)

    def closure_end(self, i: int, b: int) -> int:
        while i < b and self.t[i][1] not in (",", ";", ")", "}", "]"):
            i = self.pairs[i] + 1 if i in self.pairs else i + 1
        return min(i, b)

    def walk(self, i: int, b: int, level: int) -> None:
        t = self.t
        while i < b:
            kind, s, _ = t[i]
            before = t[i - 1][1] if i else ""
            after = t[i + 1][1] if i + 1 < len(t) else ""
            word = kind == "name" and before != "."
            if word and s == "if":
                i = self.branch(i, b, level)
                continue
            if self.rust and word and s in ("while", "for", "loop", "match") and after not in ("<",) and not (s == "for" and self._is_impl(i)):
                self.emit({"while": "while_expression", "for": "for_expression", "loop": "loop_expression", "match": "match_expression"}[s], i, level)
                open_ = self.head_end(i + 1, b)
                self.walk(i + 1, open_, level + 1)
                end = self.pairs.get(open_, b)
                if s == "match":
                    self.arms(open_ + 1, min(end, b), level + 1)
                else:
                    self.walk(open_ + 1, min(end, b), level + 1)
                i = min(end + 1, b)
                continue
            if not self.rust and word and s in ("while", "for", "switch", "catch", "do", "try"):
                head = i + 2 if s == "for" and after == "await" else i + 1
                close = self.pairs.get(head) if head < b and t[head][1] == "(" else None
                if s == "for":
                    inside = {t[j][1] for j in range(head, close or head)}
                    k = "for_in_statement" if inside & {"of", "in"} and ";" not in inside else "for_statement"
                else:
                    k = {"while": "while_statement", "switch": "switch_statement", "catch": "catch_clause", "do": "do_statement", "try": "try_statement"}[s]
                self.emit(k, i, level)
                inner = level + (s != "catch")
                if close is not None:
                    self.walk(head + 1, min(close, b), inner)
                i = self.body((close + 1) if close is not None else i + 1, b, inner)
                continue
            if not self.rust and word and s == "case":
                self.emit("switch_case", i, level)
            elif self.rust and s == "async" and after in ("{", "move"):
                self.emit("async_block", i, level)
                open_ = self.head_end(i + 1, b)
                end = self.pairs.get(open_, b)
                self.walk(open_ + 1, min(end, b), level + 1)
                i = min(end + 1, b)
                continue
            elif self.rust and s in ("|", "||") and before in ("(", ",", "=", "move", "return", "{", "=>", ""):
                j = i
                if s == "|":
                    j = i + 1
                    while j < b and t[j][1] != "|":
                        j += 1
                self.emit("closure_expression", i, level)
                end = self.closure_end(j + 1, b)
                self.walk(j + 1, end, level + 1)
                i = end
                continue
            elif s in ("&&", "||"):
                self.emit("binary_expression", i, level, False, True)
            elif self.rust and s == "?":
                self.emit("try_expression", i, level, True)
            elif not self.rust and s == "?." :
                self.emit("optional_chain", i, level, True)
            elif not self.rust and s == "?" and after not in (":", ")", ",", "="):
                self.emit("ternary_expression", i, level)
            elif not self.rust and s == "=>":
                self.emit("arrow_function", i, level)
                if after == "{":
                    end = self.pairs.get(i + 1, b)
                    self.walk(i + 2, min(end, b), level + 1)
                    i = min(end + 1, b)
                    continue
                end = self.closure_end(i + 1, b)
                self.walk(i + 1, end, level + 1)
                i = end
                continue
            elif not self.rust and word and s == "function":
                self.emit("function", i, level)
                open_ = self.head_end(i + 1, b)
                end = self.pairs.get(open_, b)
                self.walk(open_ + 1, min(end, b), level + 1)
                i = min(end + 1, b)
                continue
            i += 1

    def _is_impl(self, i: int) -> bool:
        """Whether a for at i belongs to an impl header."""
        for j in range(i - 1, max(-1, i - 40), -1):
            if self.t[j][1] in ("{", "}", ";"):
                return False
            if self.t[j][1] == "impl":
                return True
        return False

    def arms(self, i: int, b: int, level: int) -> None:
        start = i
        while i < b:
            if self.t[i][1] == "=>":
                self.emit("match_arm", start, level)
                self.walk(start, i, level)
                if i + 1 < b and self.t[i + 1][1] == "{":
                    end = self.pairs.get(i + 1, b)
                    self.walk(i + 2, min(end, b), level)
                    i = min(end + 1, b)
                    if i < b and self.t[i][1] == ",":
                        i += 1
                else:
                    end = i + 1
                    while end < b and self.t[end][1] != ",":
                        end = self.pairs[end] + 1 if end in self.pairs else end + 1
                    self.walk(i + 1, min(end, b), level)
                    i = min(end + 1, b)
                start = i
                continue
            i = self.pairs[i] + 1 if i in self.pairs else i + 1


def _halstead_kind(token: tuple[str, str, int], words: set[str]) -> str:
    kind, s, _ = token
    if kind == "name":
        return s if s in words else "true" if s == "true" else "false" if s == "false" else "null" if s in ("null", "undefined") else "identifier"
    if kind == "number":
        return "float_literal" if "." in s else "integer_literal"
    return "string_literal" if kind == "string" else s


def _result(tokens: list, pairs: dict, spans: list[tuple], rust: bool, words: set[str]) -> tuple[list, list]:
    functions, nodes = [], []
    for name, a, b, method, visible in spans:
        seq = len(functions)
        functions.append({"name": name, "start_line": tokens[a][2], "end_line": tokens[min(b, len(tokens) - 1)][2], "parameter_count": 0, "is_method": method, "visibility": visible, "seq": seq})
        open_ = next((i for i in range(a, b + 1) if tokens[i][1] == "{" or (tokens[i][1] == "=>" and not rust)), None)
        if open_ is not None and open_ < b:
            w = _Walk(tokens, pairs, rust)
            w.walk(open_ + 1, b + (tokens[b][1] != "}"), 0 if rust else 1)
            nodes += [{"seq": seq, "kind": k, "text": "", "line": line, "nest_level": level, "ignored": ignored, "logical": logical} for k, line, level, ignored, logical in w.out]
        nodes += [{"seq": seq, "kind": _halstead_kind(t, words), "text": t[1], "line": t[2], "nest_level": 0, "ignored": False, "logical": False} for t in tokens[a : b + 1]]
    return functions, nodes


def _calls(tokens: list, words: set[str], heads: set[int]) -> list[dict]:
    return [{"callee": t[1].rstrip("!"), "line": t[2]} for i, t in enumerate(tokens[:-1]) if t[0] == "name" and tokens[i + 1][1] == "(" and t[1] not in words and i not in heads and not t[1].endswith("!")]


def use_paths(tokens: list[str]) -> list[tuple[str, bool, str]]:
    """(path, wildcard, symbol) of each leaf of a use tree given as its tokens."""
    out: list[tuple[str, bool, str]] = []

    def tree(i: int, prefix: list[str]) -> int:
        path = list(prefix)
        while i < len(tokens):
            t = tokens[i]
            if t == "{":
                i += 1
                while i < len(tokens) and tokens[i] != "}":
                    i = tree(i, path)
                    if i < len(tokens) and tokens[i] == ",":
                        i += 1
                return i + 1
            if t == "*":
                out.append(("::".join(path), True, ""))
                return i + 1
            if t in (",", "}"):
                break
            if t == "as":
                i += 2
                continue
            if t != "::":
                path.append(t)
            i += 1
        if len(path) > len(prefix):
            out.append(("::".join(path), False, path[-1]))
        return i

    tree(0, [])
    return out


def parse_rust(source: str) -> dict:
    t = tokens_of(source)
    pairs = _matching(t)
    spans, imports, types, heads = [], [], [], set()
    owners = [(i, pairs.get(o, len(t))) for i, x in enumerate(t) if x[1] in ("impl", "trait") for o in [next((j for j in range(i, len(t)) if t[j][1] in ("{", ";")), len(t) - 1)]]
    i = 0
    while i < len(t):
        s = t[i][1]
        if s == "fn" and i + 1 < len(t) and t[i + 1][0] == "name":
            j = i + 2
            while j < len(t) and t[j][1] not in ("{", ";"):
                j = pairs[j] + 1 if j in pairs else j + 1
            j = min(j, len(t) - 1)
            end = pairs.get(j, j) if t[j][1] == "{" else j
            first = i
            while first and t[first - 1][1] in ("pub", "async", "unsafe", "const", "extern"):
                first -= 1
            visible = "public" if any(t[k][1] == "pub" for k in range(first, i)) else "private"
            spans.append((t[i + 1][1], first, end, any(a < i < b for a, b in owners), visible))
            heads.add(i + 1)
        elif s == "use":
            end = next((j for j in range(i, len(t)) if t[j][1] == ";"), len(t))
            leaves = use_paths([x[1] for x in t[i + 1 : end]])
            groups: dict[tuple[str, bool], list[str]] = {}
            for path, wild, symbol in leaves:
                head = path if wild else "::".join(path.split("::")[:-1]) or path
                groups.setdefault((head, wild), []).append(symbol)
            imports += [{"import_path": p, "symbols": [] if w else [x for x in names if x != p], "is_wildcard": w} for (p, w), names in groups.items()]
            i = end
        elif s in ("struct", "enum", "trait") and i + 1 < len(t) and t[i + 1][0] == "name":
            types.append({"name": t[i + 1][1], "is_abstract": s == "trait"})
        i += 1
    functions, nodes = _result(t, pairs, spans, True, _RUST_WORDS)
    return {"functions": functions, "imports": imports, "calls": _calls(t, _RUST_WORDS, heads), "types": types, "nodes": nodes}


def parse_typescript(source: str) -> dict:
    t = tokens_of(source)
    pairs = _matching(t)
    spans, imports, types, heads = [], [], [], set()
    classes = [(o, pairs.get(o, len(t))) for i, x in enumerate(t) if x[1] == "class" for o in [next((j for j in range(i, len(t)) if t[j][1] == "{"), len(t) - 1)]]

    def visible(i: int) -> str:
        return "public" if any(t[k][1] in ("public", "export") for k in range(max(0, i - 3), i)) else "private"

    for i, (kind, s, _) in enumerate(t):
        nxt = t[i + 1] if i + 1 < len(t) else ("", "", 0)
        if s == "function" and nxt[0] == "name":
            o = next((j for j in range(i, len(t)) if t[j][1] in ("{", ";")), len(t) - 1)
            if t[o][1] == "{":
                spans.append((nxt[1], i, pairs.get(o, o), False, visible(i)))
            heads.add(i + 1)
        elif s in ("const", "let", "var") and nxt[0] == "name":
            e = i + 2
            while e < len(t) and t[e][1] not in ("=", ";", ","):
                e = pairs[e] + 1 if e in pairs else e + 1
            a = e + 1 + (e + 1 < len(t) and t[e + 1][1] == "async")
            if e < len(t) and t[e][1] == "=" and a < len(t):
                arrow = pairs.get(a, a) + 1
                while arrow < len(t) and t[arrow][1] not in ("=>", ";", "{", ","):
                    arrow += 1
                if arrow < len(t) and t[arrow][1] == "=>" and (t[a][1] == "(" or t[a][0] == "name"):
                    if arrow + 1 < len(t) and t[arrow + 1][1] == "{":
                        end = pairs.get(arrow + 1, arrow + 1)
                    else:
                        end = arrow + 1
                        while end < len(t) and t[end][1] not in (";", ","):
                            end = pairs[end] + 1 if end in pairs else end + 1
                        end = min(end, len(t) - 1)
                    spans.append((nxt[1], a, end, False, visible(i)))
        elif kind == "name" and nxt[1] == "(" and s not in _TS_WORDS and any(a < i < b and not any(x < i < y for x, y in pairs.items() if a < x and y < b and t[x][1] == "{") for a, b in classes):
            close = pairs.get(i + 1, i + 1) + 1
            while close < len(t) and t[close][1] not in ("{", ";", "}"):
                close = pairs[close] + 1 if close in pairs else close + 1
            if close < len(t) and t[close][1] == "{":
                spans.append((s, i, pairs.get(close, close), True, visible(i)))
                heads.add(i)
        elif s == "import" and nxt[1] != "(":
            end = next((j for j in range(i + 1, min(len(t), i + 200)) if t[j][0] == "string"), None)
            if end is not None:
                names = [t[j][1] for j in range(i + 1, end) if t[j][0] == "name" and t[j][1] not in ("from", "type", "as") and t[j - 1][1] != "as"]
                wild = any(t[j][1] == "*" for j in range(i + 1, end))
                imports.append({"import_path": t[end][1].strip("'\"`"), "symbols": [] if wild else names, "is_wildcard": wild})
        elif s in ("class", "interface") and nxt[0] == "name":
            types.append({"name": nxt[1], "is_abstract": s == "interface" or (i > 0 and t[i - 1][1] == "abstract")})
    functions, nodes = _result(t, pairs, spans, False, _TS_WORDS)
    return {"functions": functions, "imports": imports, "calls": _calls(t, _TS_WORDS, heads), "types": types, "nodes": nodes}
