"""Symbols, references and imports of Python sources, from the standard syntax tree.

Definitions count where they stand directly in a module, a class or a function, and module
level names where they are assigned; not inside other statements. Keys are scope chains. Of a
rebound name the first assignment is the symbol; an overload family is one symbol, its
implementation if it has one; accessors have a role in their key; what else shares a chain
gets an ordinal, the first one none. A source that doesn't parse has state `failed`.
"""

from __future__ import annotations

import ast
import hashlib
import re

_TEST = re.compile(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$")
_ROLE = re.compile(r"[A-Za-z_][\w.]*\.(setter|getter|deleter)\b")
_OVERLOAD = re.compile(r"(typing\.)?overload\b")


def is_test(path: str) -> bool:
    return bool(_TEST.search(path))


class Extractor:
    def __init__(self, path: str, content: bytes):
        self.path, self.content, self.lines = path, content, [0]
        for line in content.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.imports: list[dict] = []
        self.test = is_test(path)

    def place(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def key(self, scope: list[str]) -> str:
        return f"py:{self.path}#{'.'.join(scope)}"

    def symbol(self, node: ast.AST, scope: list[str], name: str, kind: str, signature: str | None, role: str | None = None, overload: bool = False) -> None:
        a, b = self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset)
        self.symbols.append({
            "stable_key": self.key([*scope, f"{name}@{role}" if role else name]), "qualified_name": ".".join([*scope, name]), "short_name": name, "kind": kind, "signature": signature, "start_byte": a, "end_byte": b,
            "start_line": node.lineno, "end_line": node.end_lineno, "body_hash": hashlib.sha256(self.content[a:b]).hexdigest()[:16], "exported": not name.startswith("_"), "is_test": self.test, "overload": overload,
        })

    def signature(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        """The parameters in their brackets, and the return type, as they are written."""
        head = self.content[self.place(node.lineno, node.col_offset) : self.place(node.body[0].lineno, node.body[0].col_offset)].decode(errors="replace")
        start, depth, quote = head.index("("), 0, None
        end = start
        for end in range(start, len(head)):
            c = head[end]
            if quote:
                quote = None if c == quote and head[end - 1] != "\\" else quote
            elif c in "'\"":
                quote = c
            else:
                depth += (c in "([{") - (c in ")]}")
                if depth == 0:
                    break
        return head[start : end + 1] + (f" -> {ast.get_source_segment(self.content.decode(errors='replace'), node.returns)}" if node.returns else "")

    def ref(self, name: str, receiver: str | None, kind: str, line: int, column: int, scope: list[str], inside: str | None) -> None:
        self.refs.append({"from_key": self.key(scope), "name": name, "receiver": receiver, "receiver_type": inside if receiver in ("self", "cls") else None, "kind": kind, "site_line": line, "site_column": column})

    def attribute(self, node: ast.Attribute, kind: str, scope: list[str], inside: str | None) -> None:
        owner = node.value.id if isinstance(node.value, ast.Name) else None
        self.ref(node.attr, owner, kind, node.end_lineno, node.end_col_offset - len(node.attr.encode()), scope, inside)

    def annotation(self, node: ast.AST, scope: list[str], inside: str | None) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Name):
                self.ref(x.id, None, "REFERENCES", x.lineno, x.col_offset, scope, inside)

    def expression(self, node: ast.AST, scope: list[str], inside: str | None) -> None:
        """Calls and annotations below a node, and the imports of a statement."""
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                self.ref(node.func.id, None, "CALLS", node.func.lineno, node.func.col_offset, scope, inside)
            elif isinstance(node.func, ast.Attribute):
                self.attribute(node.func, "CALLS", scope, inside)
        if isinstance(node, ast.Import):
            for a in node.names:
                self.imports.append({"local": a.asname or a.name.partition(".")[0], "imported": "*", "specifier": a.name, "site_line": node.lineno})
        if isinstance(node, ast.ImportFrom):
            for a in node.names:
                self.imports.append({"local": a.asname or a.name, "imported": a.name, "specifier": "." * node.level + (node.module or ""), "site_line": node.lineno})
        for name, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    if name in ("annotation", "returns"):
                        self.annotation(child, scope, inside)
                    else:
                        self.expression(child, scope, inside)

    def visit(self, body: list[ast.stmt], scope: list[str], within: str | None, inside: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                for d in node.decorator_list:
                    if isinstance(d, ast.Name):
                        self.ref(d.id, None, "REFERENCES", d.lineno, d.col_offset, scope, inside)
                    elif isinstance(d, ast.Attribute):
                        self.attribute(d, "REFERENCES", scope, inside)
                    else:
                        self.expression(d, scope, inside)
                decorators = [ast.unparse(d) for d in node.decorator_list]
                role = next((m[1] for d in decorators if (m := _ROLE.match(d))), None)
                overload = any(_OVERLOAD.match(d) for d in decorators)
                if isinstance(node, ast.ClassDef):
                    self.symbol(node, scope, node.name, "class", None, role, overload)
                    for b in node.bases:
                        if isinstance(b, ast.Name):
                            self.ref(b.id, None, "INHERITS", b.lineno, b.col_offset, scope, inside)
                    self.visit(node.body, [*scope, node.name], "class", node.name)
                else:
                    self.symbol(node, scope, node.name, "method" if within == "class" else "function", self.signature(node), role, overload)
                    if node.returns:
                        self.annotation(node.returns, scope, inside)
                    self.visit(node.body, [*scope, node.name], "function", inside)
                continue
            if not scope and isinstance(node, (ast.Assign, ast.AnnAssign)):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                if isinstance(target, ast.Name):
                    self.symbol(node, scope, target.id, "variable", None)
            self.expression(node, scope, inside)

    def kept(self) -> list[dict]:
        """The symbols with unique keys, in the order of the source."""
        groups: dict[str, list[dict]] = {}
        for s in self.symbols:
            groups.setdefault(s["stable_key"], []).append(s)
        out = []
        for s in self.symbols:
            group = groups[s["stable_key"]]
            if len(group) > 1:
                real = [x for x in group if not x["overload"]]
                if group[0]["kind"] == "variable" or len(real) <= 1 and len(real) < len(group):
                    first = group[0] if group[0]["kind"] == "variable" or not real else real[0]
                    if s is not first:
                        continue
            n = next(i for i, x in enumerate(group) if x is s)
            alone = len(group) == 1 or group[0]["kind"] == "variable" or any(x["overload"] for x in group) and sum(not x["overload"] for x in group) <= 1
            key = s["stable_key"] if n == 0 or alone else f"{s['stable_key']}${n + 1}"
            out.append({**{k: v for k, v in s.items() if k != "overload"}, "stable_key": key})
        return out


def extract(path: str, content: bytes) -> tuple[str, list[dict], list[dict], list[dict], list[dict]]:
    """State, symbols, references, imports and exports (none) of one file."""
    try:
        made = Extractor(path, content)
        made.visit(ast.parse(content).body, [], None, None)
    except (SyntaxError, ValueError, RecursionError):
        return "failed", [], [], [], []
    return "ok", made.kept(), made.refs, made.imports, []
