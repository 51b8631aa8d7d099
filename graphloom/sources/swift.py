"""Symbols, references and imports of Swift sources, by a scanner of tokens.

Types, protocols, functions, initialisers, subscripts and bindings are recognised by their
keywords and brackets; members of an extension go to the chain of the type that it extends.
Calls, conformances and the types of bindings are references; a receiver that is a typed
binding or parameter of the same symbol has that type. Only brackets make a call: one with
nothing but a trailing closure isn't seen. A source whose brackets don't match has state
`failed` and no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from graphloom.sources.typescript import Scanner, Token

_TOKEN = re.compile(r"(?P<skip>\s+|//[^\n]*)|(?P<name>`?[A-Za-z_\u0080-￿][\w\u0080-￿]*`?)|(?P<number>\d[\w.]*)|(?P<sign>->|\.\.[.<]|[=!<>]=|&&|\|\||\?\?|.)", re.S)
_TEST = re.compile(r"(^|/)Tests/|Tests?\.swift$")
_TARGET = re.compile(r"(?:^|/)(?:Sources|Tests)/([^/]+)/")
# Fixed values of the language.
VISIBILITY = ["fileprivate", "private", "internal", "public", "open"]
MODIFIERS = {*VISIBILITY, "static", "final", "override", "mutating", "nonmutating", "lazy", "weak", "unowned", "required", "convenience", "indirect", "dynamic", "optional", "prefix", "postfix", "infix", "nonisolated", "isolated", "async"}
TYPES = {"class": "class", "struct": "class", "actor": "class", "enum": "enum", "protocol": "interface"}
NO_CALLS = {"if", "guard", "while", "for", "switch", "return", "in", "catch", "case", "where", "func", "init", "subscript", "deinit", "throw", "try", "await", "is", "as", "else", "repeat", "defer", "some", "any", "inout", "throws", "rethrows", "async"}


def is_test(path: str) -> bool:
    return bool(_TEST.search(path))


def target(path: str) -> str | None:
    """The package target that a path belongs to."""
    found = _TARGET.search(path)
    return found and found[1]


def tokenise(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        if source.startswith("/*", at):  # comments nest
            depth = 0
            for m in re.compile(r"/\*|\*/").finditer(source, at):
                depth += 1 if m.group() == "/*" else -1
                if not depth:
                    break
            if depth:
                raise ValueError("an open comment")
            at = m.end()
        elif source[at] == '"':
            end = _string(source, at)
            out.append(Token(source[at:end], "string", at))
            at = end
        else:
            m = _TOKEN.match(source, at)
            if m.lastgroup != "skip":
                out.append(Token(m.group(), m.lastgroup, at))
            at = m.end()
    return out


def _string(source: str, at: int) -> int:
    """The end of a string, whose parts in \\() may hold others."""
    mark = '"""' if source.startswith('"""', at) else '"'
    at += len(mark)
    while at < len(source):
        if source.startswith("\\(", at):
            depth, at = 1, at + 2
            while depth:
                if at >= len(source):
                    raise ValueError("an open string")
                if source[at] == '"':
                    at = _string(source, at)
                    continue
                depth += (source[at] == "(") - (source[at] == ")")
                at += 1
        elif source[at] == "\\":
            at += 2
        elif source.startswith(mark, at):
            return at + len(mark)
        elif mark == '"' and source[at] == "\n":
            break
        else:
            at += 1
    raise ValueError("an open string")


class SwiftScanner(Scanner):
    def __init__(self, source: str):
        super().__init__(source, tokenise(source))
        self.typed: list[tuple[int, str, str]] = []  # place, name and type of bindings and parameters

    def declared(self, name: str, kind: str, a: int, b: int, chain: list[str], visibility: str, body: int | None) -> list[str]:
        end = self.tokens[b].at + len(self.text(b))
        text = self.source[self.tokens[a].at : self.tokens[body].at if body is not None else end]
        self.found.symbols.append({"chain": [*chain, name], "kind": kind, "signature": re.sub(r"\s+", " ", text).strip(), "start": self.tokens[a].at, "end": end, "visibility": visibility})
        return [*chain, name]

    def type_end(self, i: int, b: int) -> int:
        """The place after a type that begins at i."""
        while i < b:
            t = self.text(i)
            if t == "where":
                return i
            if i in self.close and t in "([":
                i = self.close[i] + 1
            elif t == "<":
                i = max(self.angle(i), i + 1)
            elif self.name(i) or t in ("?", "!", ".", "&", "->", "@"):
                if self.name(i) and self.name(i - 1) and self.text(i - 1) not in ("some", "any", "inout", "borrowing", "consuming", "throws", "async", "escaping"):
                    return i
                if self.name(i) and self.fresh_line(i) and self.text(i - 1) not in ("->", "&", ".", ":"):
                    return i
                i += 1
            else:
                return i
        return i

    def last_type(self, a: int, b: int) -> str | None:
        found = [self.text(k) for k in range(a, b) if self.name(k) and self.text(k) not in NO_CALLS]
        return found[-1] if found else None

    def arguments(self, a: int, b: int) -> None:
        """Names and types of the parameters between the round brackets a and b."""
        i = a + 1
        while i < b:
            if self.text(i) == ":" and self.name(i - 1):
                end = self.type_end(i + 1, b)
                written = self.last_type(i + 1, end)
                if written:
                    self.typed.append((self.tokens[i - 1].at, self.text(i - 1), written))
                i = max(end, i + 1)
                continue
            i = self.close.get(i, i) + 1

    def conform(self, colon: int, brace: int, keyword: str) -> None:
        i = colon + 1
        while i < brace and self.text(i) != "where":
            end = i
            while end < brace and self.text(end) not in (",", "where"):
                end = max(self.angle(end), self.close.get(end, end) + 1)
            names = [k for k in range(i, end) if self.name(k) and self.text(k - 1) != "<"]
            plain = [k for k in names if not any(self.text(m) == "<" for m in range(i, k))]
            if plain:
                self.found.refs.append({"name": self.text(plain[-1]), "receiver": None, "kind": "CONFORMS " + keyword, "at": self.tokens[plain[-1]].at, "line": self.line(plain[-1])})
            if self.text(end) == "where":
                break
            i = end + 1

    def scan(self, a: int, b: int, chain: list[str], container: str, inherited: str = "internal") -> None:
        """Declarations and expressions from token a to b. container: type, function or top."""
        i, start, visibility = a, None, None
        while i < b:
            t = self.text(i)
            if t == "@" and self.name(i + 1):
                start = i if start is None else start
                i += 2
                if self.text(i) == "(" and not self.fresh_line(i):
                    i = self.close[i] + 1
                continue
            follows = self.name(i + 1) or self.text(i + 1) in ("(", "@")
            if self.name(i) and follows and (t in MODIFIERS or t == "class" and self.text(i + 1) in ("func", "var", "let", "subscript")) and self.text(i - 1) != ".":
                start = i if start is None else start
                if t in VISIBILITY and self.text(i + 1) != "(":
                    visibility = t
                i = self.close[i + 1] + 1 if self.text(i + 1) == "(" and t in (*VISIBILITY, "unowned") else i + 1
                continue
            first, shown = (i if start is None else start), visibility or inherited
            start = visibility = None
            done = self.declares(i, first, b, chain, container, shown) if self.name(i) and self.text(i - 1) != "." else None
            if done:
                i = done
                continue
            if self.name(i) and t not in NO_CALLS:
                j = self.angle(i + 1)
                if self.text(j) == "(" and not self.fresh_line(j):
                    receiver = None
                    if self.text(i - 1) == "." and i >= 2:
                        k = i - 2
                        k = k - 1 if self.text(k) in ("?", "!") else k
                        receiver = self.source[self.tokens[self.begin(k)].at : self.tokens[i - 1].at].strip().rstrip("?!")
                    self.found.refs.append({"name": t, "receiver": receiver, "kind": "CALLS", "at": self.tokens[self.begin(i) if receiver else i].at, "line": self.line(i)})
            i += 1

    def declares(self, i: int, first: int, b: int, chain: list[str], container: str, shown: str) -> int | None:
        """The place after a declaration whose keyword is at i, or None."""
        t = self.text(i)
        if t == "import" and container == "top" and self.name(i + 1):
            j = i + 1
            if self.text(j) in ("class", "struct", "enum", "protocol", "func", "typealias", "var", "let") and self.name(j + 1):
                j += 1
            parts = [self.text(j)]
            while self.text(j + 1) == "." and self.name(j + 2):
                parts.append(self.text(j + 2))
                j += 2
            self.found.imports.append({"local": parts[-1], "imported": "*" if len(parts) == 1 else parts[-1], "specifier": parts[0], "line": self.line(i)})
            return j + 1
        if (t in TYPES or t == "extension") and self.name(i + 1):
            j = i + 2
            while self.text(j) == "." and self.name(j + 1):
                j += 2
            name = self.span(i + 1, j).strip()
            brace = colon = self.angle(j)
            while brace < b and self.text(brace) != "{":
                brace = self.close.get(brace, brace) + 1
            if brace >= b:
                return None
            inside = name.split(".") if t == "extension" else self.declared(name, TYPES[t], first, self.close[brace], chain, shown, brace)
            if self.text(colon) == ":":
                self.conform(colon, brace, t)
            self.scan(brace + 1, self.close[brace], inside, "type", shown)
            return self.close[brace] + 1
        if t in ("typealias", "associatedtype") and self.name(i + 1):
            end = i + 2
            if self.text(self.angle(end)) in ("=", ":"):
                end = self.type_end(self.angle(end) + 1, b)
            self.declared(self.text(i + 1), "type", first, end - 1, chain, shown, None)
            return end
        if t == "func" or t in ("init", "subscript", "deinit") and container == "type" and self.text(i - 1) != ".":
            j = i + 1 if t == "func" else i
            name = self.text(j)
            j += 1
            while t == "func" and not self.name(j - 1) and self.text(j) not in ("(", "<") and j < b:  # an operator
                name += self.text(j)
                j += 1
            j += self.text(j) in ("?", "!")
            k = self.angle(j)
            if self.text(k) != "(" and t != "deinit":
                return None
            after = self.close[k] + 1 if t != "deinit" else k
            while self.text(after) in ("async", "throws", "rethrows"):
                after += 1
                after = self.close[after] + 1 if self.text(after - 1) == "throws" and self.text(after) == "(" else after
            if self.text(after) == "->":
                after = self.type_end(after + 1, b)
            if self.text(after) == "where":
                while after < b and self.text(after) != "{" and not self.fresh_line(after + 1):
                    after += 1
            body = after if self.text(after) == "{" else None
            last = self.close[body] if body is not None else after - 1
            inside = self.declared(name, "method" if container == "type" or t != "func" else "function", first, last, chain, shown, body)
            if t != "deinit":
                self.arguments(k, self.close[k])
            if body is not None:
                self.scan(body + 1, last, inside, "function")
            return last + 1
        if t in ("var", "let") and self.name(i + 1):
            name, j = self.text(i + 1), i + 2
            annotation = None
            if self.text(j) == ":":
                end = self.type_end(j + 1, b)
                annotation, j = (j + 1, end), end
            value = None
            if self.text(j) == "=":
                value = j + 1
                j = value
                while j < b:
                    if j > value and (self.text(j) in (";", ",") or self.fresh_line(j) and (self.tokens[j - 1].kind != "sign" or self.text(j - 1) in ")]}?!") and self.text(j) not in (".", "??", "+", "-", "?", "&&", "||", ":")):
                        break
                    if self.text(j) in ("{", "else") and self.text(i - 1) in ("if", "guard", "while", ","):
                        break
                    j = self.close.get(j, j) + 1
                j = min(j, b)
            accessors = j if self.text(j) == "{" and self.text(i - 1) not in ("if", "guard", "while", ",") and j < b else None
            last = self.close[accessors] if accessors is not None else max(i + 1, j - 1)
            inside = self.declared(name, "property" if container == "type" else "variable", first, last, chain, shown, None)
            if annotation:
                written = self.last_type(*annotation)
                if written:
                    self.typed.append((self.tokens[i + 1].at, name, written))
                for k in range(*annotation):
                    if self.name(k) and self.text(k) not in NO_CALLS and self.text(k) != "Self":
                        self.found.refs.append({"name": self.text(k), "receiver": None, "kind": "REFERENCES", "at": self.tokens[k].at, "line": self.line(k)})
            if value is not None:
                self.scan(value, j, inside, "function")
            if accessors is not None:
                self.scan(accessors + 1, last, inside, "function")
            return last + 1
        return None


def extract(path: str, content: bytes) -> tuple[str, list[dict], list[dict], list[dict], list[dict]]:
    """State, symbols, references, imports and exports (none) of one file."""
    source = content.decode(errors="replace")
    try:
        scanner = SwiftScanner(source)
        scanner.scan(0, scanner.n, [], "top")
    except (ValueError, IndexError, KeyError, RecursionError):
        return "failed", [], [], [], []
    found, wide = scanner.found, [0]
    for c in source:
        wide.append(wide[-1] + len(c.encode(errors="replace")))
    symbols = sorted(found.symbols, key=lambda s: (s["start"], -s["end"]))
    groups: dict[str, list[dict]] = {}
    for s in symbols:
        groups.setdefault(".".join(s["chain"]), []).append(s)
    for chain, group in groups.items():
        seen: dict[str, int] = {}
        for s in group:
            mark = hashlib.sha256(s["signature"].encode()).hexdigest()[:8]
            seen[mark] = seen.get(mark, 0) + 1
            s["key"] = f"swift:{path}#{chain}" + ("" if len(group) == 1 else f"~{mark}" + (f"~{seen[mark]}" if seen[mark] > 1 else ""))
    line = lambda at: bisect_left(scanner.lines, at) + 1
    rows = [{
        "stable_key": s["key"], "qualified_name": ".".join(s["chain"]), "short_name": s["chain"][-1], "kind": s["kind"], "signature": s["signature"], "start_byte": wide[s["start"]], "end_byte": wide[s["end"]], "start_line": line(s["start"]), "end_line": line(s["end"]),
        "body_hash": hashlib.sha256(source[s["start"] : s["end"]].encode()).hexdigest(), "exported": s["visibility"] in ("public", "open"), "is_test": is_test(path), "visibility": s["visibility"],
    } for s in symbols]

    def owner(at: int, other: str | None = None) -> dict | None:
        around = [s for s in symbols if s["start"] <= at < s["end"] and s["chain"][-1] != other]
        return max(around, key=lambda s: s["start"], default=None)

    held = [(at, name, written, owner(at, name)) for at, name, written in scanner.typed]
    protocols = {s["chain"][-1] for s in symbols if s["kind"] == "interface"}
    refs = []
    for r in sorted(found.refs, key=lambda r: r["at"]):
        own = owner(r["at"])
        if own is None and not r["kind"].startswith("CONFORMS"):
            continue
        known = [(at, written) for at, name, written, place in held if name == r["receiver"] and place is own and at <= r["at"]]
        kind = r["kind"]
        if kind.startswith("CONFORMS"):
            kind = "INHERITS" if kind == "CONFORMS class" and r["name"] not in protocols else "IMPLEMENTS"
        if own is None:
            continue
        refs.append({"from_key": own["key"], "name": r["name"], "receiver": r["receiver"], "receiver_type": max(known)[1] if known else None, "kind": kind, "site_line": r["line"], "site_column": r["at"] - (source.rfind("\n", 0, r["at"]) + 1)})
    imports = [{"local": x["local"], "imported": x["imported"], "specifier": x["specifier"], "site_line": x["line"]} for x in found.imports]
    return "ok", rows, refs, imports, []
