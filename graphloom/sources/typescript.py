"""Symbols, references, imports and exports of TypeScript sources, by a scanner of tokens.

No parser of the language is at hand, so declarations are recognised by their keywords and
brackets: functions, classes with methods and fields, interfaces, type aliases with their
members, enums, namespaces, and single bindings of const, let and var. Calls, constructions,
heritage, type annotations and identifiers given as arguments are references. A source whose
brackets don't match has state `failed` and no rows. Not seen: object literal methods, JSX
elements, calls inside template strings, annotations inside destructuring, and types of
class expressions.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<name>[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*)|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<number>\d[\w.]*)|(?P<sign>=>|\.\.\.|\?\.|[=!<>]==?|&&|\|\||\?\?|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
# Words of the language that are no names of what is called, and types that it defines.
KEYWORDS = {"async", "if", "for", "while", "switch", "catch", "return", "typeof", "await", "yield", "function", "class", "new", "super", "import", "constructor", "in", "of", "do", "else", "case", "delete", "void", "throw", "with", "instanceof"}
PREDEFINED = {"string", "number", "boolean", "any", "void", "unknown", "never", "object", "symbol", "null", "undefined", "this", "true", "false", "keyof", "typeof", "readonly", "infer", "is", "asserts", "extends", "unique", "in", "bigint", "new", "as", "out", "abstract"}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "accessor"}
_TEST = re.compile(r"(^|/)(tests?|__tests__)/|\.(test|spec)\.[cm]?tsx?$")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def is_test(path: str) -> bool:
    return bool(_TEST.search(path))


@dataclass
class Token:
    text: str
    kind: str
    at: int


@dataclass
class Found:
    """What one file has; places are of characters until the rows are made."""

    symbols: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)


def tokenise(source: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(source):
        c, last = source[at], out[-1] if out else None
        if c == "`":
            end = _template(source, at)
            out.append(Token(source[at:end], "string", at))
            at = end
            continue
        starts = last is None or last.text in "=([{,;:!&|?+-*%<>~^" or last.text in ("=>", "return", "typeof", "case", "&&", "||", "??", "==", "===", "!=", "!==")
        if c == "/" and source[at + 1 : at + 2] not in ("/", "*") and starts and (m := _REGEX.match(source, at)):
            out.append(Token(m.group(), "string", at))
            at = m.end()
            continue
        m = _TOKEN.match(source, at)
        if m.lastgroup != "skip":
            out.append(Token(m.group(), m.lastgroup, at))
        at = m.end()
    return out


def _template(source: str, at: int) -> int:
    """The end of a template string, whose parts in ${} may hold others."""
    depth, at = 0, at + 1
    while at < len(source):
        c = source[at]
        if c == "\\":
            at += 1
        elif depth == 0 and c == "`":
            return at + 1
        elif depth == 0 and source.startswith("${", at):
            depth, at = 1, at + 1
        elif depth and c == "`":
            at = _template(source, at) - 1
        elif depth and c in "{}":
            depth += 1 if c == "{" else -1
        at += 1
    raise ValueError("an open template string")


class Scanner:
    def __init__(self, source: str, tokens: list[Token] | None = None):
        self.source, self.tokens, self.found = source, tokenise(source) if tokens is None else tokens, Found()
        self.n = len(self.tokens)
        self.close: dict[int, int] = {}
        stack = []
        for i, t in enumerate(self.tokens):
            if t.kind == "sign" and t.text in "([{":
                stack.append(i)
            elif t.kind == "sign" and t.text in ")]}":
                if not stack or self.tokens[stack[-1]].text != _PAIRS[t.text]:
                    raise ValueError("brackets that don't match")
                self.close[stack.pop()] = i
        if stack:
            raise ValueError("an open bracket")
        self.opens = {b: a for a, b in self.close.items()}
        self.lines = [m.start() for m in re.finditer("\n", source)]

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < self.n else ""

    def name(self, i: int) -> bool:
        return 0 <= i < self.n and self.tokens[i].kind == "name"

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.tokens[i].at - 1) + 1 if self.tokens[i].at else 1

    def span(self, a: int, b: int) -> str:
        """Source from token a up to and without token b."""
        return self.source[self.tokens[a].at : self.tokens[b].at if b < self.n else len(self.source)]

    def fresh_line(self, i: int) -> bool:
        """Whether a line ends before token i."""
        return i >= self.n or "\n" in self.source[self.tokens[i - 1].at + len(self.text(i - 1)) : self.tokens[i].at]

    def angle(self, i: int) -> int:
        """The place after the type parameters or arguments that may begin at i, else i."""
        if self.text(i) != "<":
            return i
        depth = 0
        for j in range(i, min(self.n, i + 400)):
            t = self.text(j)
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j + 1
            if t in (";", "&&", "||"):
                break
        return i

    def symbol(self, name: str, kind: str, a: int, b: int, chain: list[str], exported: bool, body: int | None = None) -> list[str]:
        """Adds the symbol of the tokens a to b (inclusive) and gives the chain inside it."""
        text = re.sub(r"\s+", " ", self.span(a, body if body is not None else b + 1) if body is not None else self.source[self.tokens[a].at : self.tokens[b].at + len(self.text(b))]).strip().removesuffix(";")
        self.found.symbols.append({"chain": [*chain, name], "kind": kind, "signature": text, "start": self.tokens[a].at, "end": self.tokens[b].at + len(self.text(b)), "exported": exported})
        return [*chain, name]

    def ref(self, i: int, receiver: str | None, kind: str) -> None:
        self.found.refs.append({"name": self.text(i), "receiver": receiver, "kind": kind, "at": self.tokens[i].at, "line": self.line(i)})

    def end_of_type(self, i: int, stops: str) -> int:
        """The place of the first of `stops` after a type that begins at i, outside its brackets."""
        depth = 0
        while i < self.n:
            t = self.text(i)
            if depth == 0 and (t in stops.split() or (t == "\n")):
                return i
            if t in ")]}" and i not in self.close and self.tokens[i].kind == "sign":
                return i
            if i in self.close and t in "([{":
                i = self.close[i]
            elif t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
            i += 1
        return i

    def types(self, a: int, b: int) -> None:
        """References to the types named among the tokens a to b."""
        i = a
        while i < b:
            if self.name(i) and self.text(i) not in PREDEFINED and self.text(i + 1) not in (":",) and not (self.text(i + 1) == "?" and self.text(i + 2) == ":"):
                j, receiver = i, None
                while self.text(j + 1) == "." and self.name(j + 2):
                    j += 2
                    receiver = self.span(i, j - 1).strip()
                if self.text(j + 1) != "=>":
                    self.ref(j, receiver, "REFERENCES")
                i = j
            i += 1

    def parameters(self, a: int, b: int, chain: list[str]) -> None:
        """Annotations and default values between the round brackets a and b."""
        i = a + 1
        while i < b:
            if self.text(i) == ":":
                end = min(b, self.end_of_type(i + 1, ", ="))
                self.types(i + 1, end)
                i = end
            if self.text(i) == "=":
                end = i + 1
                while end < b and self.text(end) != ",":
                    end = self.close.get(end, end) + 1
                self.code(i + 1, min(end, b), chain)
                i = end
            i = self.close.get(i, i) + 1

    def routine(self, i: int, chain_of, chain: list[str]) -> tuple[int, int | None, int]:
        """From the round bracket of a routine's parameters: its last token, its body's bracket and where its text goes on.

        chain_of(last, body) adds the symbol and gives the chain inside it.
        """
        shut = self.close[i]
        j, returns = shut + 1, None
        if self.text(j) == ":":
            stop = self.end_of_type(j + 1, "{ ; =>" if self.text(j + 1) != "{" else "; =>")
            if self.text(j + 1) == "{" and self.text(self.close[j + 1] + 1) == "{":
                stop = self.close[j + 1] + 1
            for k in range(j + 1, stop):  # without a body a line's end may close it
                if k > j + 1 and self.fresh_line(k) and self.text(k - 1) not in "|&<,(" and self.text(k) not in "|&>,)":
                    stop = k
                    break
            returns, j = (j + 1, stop), stop
        body = j if self.text(j) == "{" else None
        last = self.close[body] if body is not None else j if self.text(j) == ";" else j - 1
        inside = chain_of(last, body)
        self.parameters(i, shut, inside)
        if returns:
            self.types(*returns)
        if body is not None:
            self.code(body + 1, last, inside)
        return last, body, last + 1

    def members(self, a: int, b: int, chain: list[str], exported: bool, signatures: bool) -> None:
        """Methods and fields between the braces of a class, an interface or an object type."""
        i = a
        while i < b:
            if self.text(i) == "@":  # a decorator
                i += 2
                while self.text(i) == "." and self.name(i + 1):
                    i += 2
                i = self.close.get(i, i - 1) + 1 if self.text(i) == "(" else i
                continue
            start = i
            while self.text(i) in MODIFIERS and self.text(i + 1) not in ("(", ":", "=", ";", "?", "!", "<", ",", "}"):
                i += 1
            if self.text(i) in ("get", "set") and self.name(i + 1):
                i += 1
            if self.text(i) == "*":
                i += 1
            if self.text(i) == "{":  # a static block
                self.code(i + 1, self.close[i], chain)
                i = self.close[i] + 1
                continue
            key = self.text(i)
            if not (self.name(i) or self.tokens[i].kind == "string") or i >= b:
                if i in self.close:  # an index signature or a computed name
                    i = self.close[i]
                i += 1
                continue
            key = key.strip("'\"")
            j = i + 1
            if self.text(j) in ("?", "!"):
                j += 1
            k = self.angle(j)
            if self.text(k) == "(":
                last, _, i = self.routine(k, lambda last, body: self.symbol(key, "method", start, last, chain, exported, body), chain)
                continue
            value = None
            if self.text(j) == ":":
                end = min(b, self.end_of_type(j + 1, "; , ="))
                for m in range(j + 2, end):
                    if self.fresh_line(m) and self.text(m - 1) not in ("|", "&", "<", ",", "=>", "(", ":") and self.text(m) not in ("|", "&", ">", ")"):
                        end = m
                        break
                annotation, j = (j + 1, end), end
            else:
                annotation = None
            if self.text(j) == "=" and not signatures:
                value, j = j + 1, self.statement_end(j + 1, b)
            last = max(start, j - 1)
            inside = self.symbol(key, "property", start, last, chain, exported)
            if annotation:
                self.types(*annotation)
            if value is not None:
                self.code(value, j, inside)
            i = j + 1 if self.text(j) in (";", ",") else max(j, i + 1)

    def statement_end(self, i: int, b: int) -> int:
        """The place after an expression that begins at i: at a semicolon, a comma, or a line's end that closes it."""
        begin = i
        while i < b:
            t = self.text(i)
            if t in (";", ","):
                return i
            if i > begin and self.fresh_line(i) and (self.tokens[i - 1].kind != "sign" or self.text(i - 1) in ")]}") and (self.tokens[i].kind != "sign" or t in "{@#"):
                return i
            i = self.close.get(i, i) + 1
        return min(i, b)

    def code(self, a: int, b: int, chain: list[str], top: bool = False) -> None:
        """Statements and expressions from token a to b."""
        i, exported, fresh = a, False, a
        while i < b:
            t, before = self.text(i), self.text(i - 1)
            if t == ";" or (t in "{}" and self.tokens[i].kind == "sign"):
                exported = False
            if not self.name(i) or before in (".", "?."):
                if t == "(" and self.text(self.close[i] + 1) in ("=>", ":") and before not in ("?",):
                    after = self.close[i] + 1
                    if self.text(after) == "=>":
                        self.parameters(i, self.close[i], chain)
                        i = after + 1
                        continue
                    stop = self.end_of_type(after + 1, "=> ; , {") if self.text(after) == ":" else after
                    if self.text(stop) == "=>" and (before in ("=", "(", ",", "=>", "async", "return", ":") or not self.name(i - 1)):
                        self.parameters(i, self.close[i], chain)
                        self.types(after + 1, stop)
                        i = stop + 1
                        continue
                i = self.call(i, chain)
                continue
            if t == "import" and self.text(i + 1) not in ("(", "."):
                i = self.imported(i)
                continue
            if t == "export":
                exported = True
                i = self.exported(i)
                continue
            if t in ("default", "declare", "abstract", "async") and self.name(i + 1):
                fresh = i if t in ("abstract", "async") else i + 1
                if self.text(i + 1) in ("function", "class", "abstract", "async"):
                    start = fresh
                    while self.text(i + 1) in ("abstract", "async"):
                        i += 1
                    i = self.declaration(i + 1, start, chain, exported) or i + 1
                    exported = False
                    continue
                i += 1
                continue
            done = self.declaration(i, i, chain, exported)
            if done:
                i, exported = done, False
                continue
            i = self.call(i, chain)

    def declaration(self, i: int, start: int, chain: list[str], exported: bool) -> int | None:
        """The place after a declaration whose keyword is at i, or None."""
        t = self.text(i)
        if t == "function":
            j = i + 2 if self.text(i + 1) == "*" else i + 1
            if not self.name(j):
                if self.text(i - 1) == "default" and self.text(self.angle(j)) == "(":
                    return self.routine(self.angle(j), lambda last, body: chain, chain)[2]
                return None
            k = self.angle(j + 1)
            if self.text(k) != "(":
                return None
            if self.text(i - 1) in ("=", "(", ",", ":", "return", "=>"):  # a named function expression is no declaration
                return self.routine(k, lambda last, body: chain, chain)[2]
            return self.routine(k, lambda last, body: self.symbol(self.text(j), "function", start, last, chain, exported, body), chain)[2]
        if t in ("class", "interface") and (self.name(i + 1) or t == "class"):
            named = self.name(i + 1) and self.text(i + 1) not in ("extends", "implements")
            j = i + 2 if named else i + 1
            name = self.text(i + 1) if named else "default" if self.text(i - 1) == "default" else None
            brace = j
            while brace < self.n and self.text(brace) != "{":
                if self.text(brace) in (";", "=", ")"):
                    return None
                brace = self.close.get(brace, brace) + 1
            if brace >= self.n:
                return None
            last = self.close[brace]
            inside = self.symbol(name, t, start, last, chain, exported, brace) if name else chain
            self.heritage(self.angle(j), brace, t == "class")
            self.members(brace + 1, last, inside, exported, t == "interface")
            return last + 1
        if t == "enum" and self.name(i + 1) and self.text(i + 2) == "{":
            start = start if self.text(i - 1) != "const" else start
            self.symbol(self.text(i + 1), "enum", start, self.close[i + 2], chain, exported, i + 2)
            return self.close[i + 2] + 1
        if t in ("namespace", "module") and self.name(i + 1) and self.text(i + 2) in ("{", "."):
            j = i + 2
            while self.text(j) == ".":
                j += 2
            if self.text(j) != "{":
                return None
            inside = self.symbol(self.span(i + 1, j).strip(), "module", start, self.close[j], chain, exported, j)
            self.code(j + 1, self.close[j], inside)
            return self.close[j] + 1
        if t == "type" and self.name(i + 1) and self.text(self.angle(i + 2)) == "=":
            equals = self.angle(i + 2)
            end = equals + 1
            while end < self.n and self.text(end) != ";":
                if end > equals + 1 and self.fresh_line(end) and self.text(end) not in ("|", "&", "?", ":", "=>", ")", "]", ">", ",", "extends") and self.text(end - 1) not in ("|", "&", "=", "?", ":", "=>", "<", ",", "extends"):
                    break
                end = self.close.get(end, end) + 1
            end = min(end, self.n)
            last = end if end < self.n and self.text(end) == ";" else end - 1
            inside = self.symbol(self.text(i + 1), "type", start, last, chain, exported)
            k = equals + 1
            while k < end:
                if self.text(k) == "{" and k in self.close:
                    self.members(k + 1, self.close[k], inside, exported, True)
                    k = self.close[k]
                k += 1
            return last + 1
        if t in ("const", "let", "var") and i + 1 < self.n:
            if self.text(i + 1) == "enum":
                return self.declaration(i + 1, start, chain, exported)
            return self.bindings(i + 1, chain, exported)
        return None

    def bindings(self, i: int, chain: list[str], exported: bool) -> int:
        """`a: T = x, b = y` after const, let or var."""
        while i < self.n:
            simple, j = self.name(i), i + 1
            if not simple:
                j = self.close.get(i, i) + 1
            annotation = None
            if self.text(j) == "!":
                j += 1
            if self.text(j) == ":":
                end = self.end_of_type(j + 1, "= ; ,")
                for m in range(j + 2, end):
                    if self.fresh_line(m) and self.text(m - 1) not in ("|", "&", "<", ",", "=>", "("):
                        end = m
                        break
                annotation, j = (j + 1, end), end
            if self.text(j) in ("of", "in"):
                if simple:
                    self.symbol(self.text(i), "variable", i, i, chain, exported)
                return j + 1
            value, end = None, j
            if self.text(j) == "=":
                value = j + 1
                end = self.statement_end(value, self.n)
                # the bracket of a for statement, or of the block, closes it
                k = value
                while k < end:
                    if self.tokens[k].kind == "sign" and self.text(k) in ")]}":
                        end = k
                        break
                    k = self.close.get(k, k) + 1
            inside = chain
            if simple:
                inside = self.symbol(self.text(i), "function" if value is not None and self.is_function(value, end) else "variable", i, max(i, end - 1), chain, exported)
            if annotation:
                self.types(*annotation)
            if value is not None:
                self.code(value, end, inside)
            if self.text(end) != ",":
                return end
            i = end + 1
        return i

    def is_function(self, i: int, b: int) -> bool:
        """Whether an arrow function or a function expression begins at i."""
        if self.text(i) == "async" and self.text(i + 1) != "=>":
            i += 1
        if self.text(i) == "function" or self.name(i) and self.text(i + 1) == "=>":
            return True
        i = self.angle(i)
        if self.text(i) != "(" or i >= b:
            return False
        after = self.close[i] + 1
        return self.text(after) == "=>" or self.text(after) == ":" and self.text(self.end_of_type(after + 1, "=> ; ,")) == "=>"

    def heritage(self, a: int, b: int, is_class: bool) -> None:
        """`extends X<T>, implements A, b.C` between a class's name and its brace; an interface's heritage isn't recorded."""
        mode, i = None, a
        while i < b and is_class:
            if self.text(i) in ("extends", "implements"):
                mode, i = self.text(i), i + 1
                continue
            if mode and self.name(i):
                first = i
                while self.text(i + 1) == "." and self.name(i + 2):
                    i += 2
                self.ref(i, self.span(first, i - 1).strip() if i > first else None, "INHERITS" if mode == "extends" else "IMPLEMENTS")
                i = max(i + 1, self.angle(i + 1))
                if self.text(i) == "(":  # a mixin's call
                    i = self.close[i] + 1
                continue
            i += 1

    def call(self, i: int, chain: list[str]) -> int:
        """Notes a call or construction at i; gives the place to go on from."""
        if not self.name(i) or self.text(i) in KEYWORDS and self.text(i - 1) not in (".", "?."):
            return i + 1
        j = self.angle(i + 1)
        if self.text(j) == "?." and self.text(j + 1) == "(":
            j += 1
        bare = self.text(j) != "(" and self.constructed(i)
        if self.text(j) != "(" and not bare:
            return i + 1
        if self.text(i - 1) in ("function", "class"):
            return i + 1
        receiver = None
        if self.text(i - 1) in (".", "?."):
            receiver = self.source[self.tokens[self.begin(i - 2)].at : self.tokens[i - 1].at].strip()
        self.ref(i, receiver, "CALLS")
        if not bare:
            for k in range(j + 1, self.close[j]):
                if self.name(k) and self.text(k) not in PREDEFINED | KEYWORDS and (k == j + 1 or self.text(k - 1) == ",") and self.text(k + 1) in (",", ")") and self.depth(j, k):
                    self.ref(k, None, "REFERENCES")
        return i + 1

    def constructed(self, i: int) -> bool:
        """Whether `new` stands before the member expression that ends at i, which isn't itself continued."""
        return self.text(i + 1) not in (".", "?.") and self.text(self.begin(i) - 1) == "new"

    def depth(self, bracket: int, k: int) -> bool:
        """Whether token k lies directly in the bracket."""
        i = bracket + 1
        while i < k:
            i = self.close.get(i, i) + 1
        return i == k

    def begin(self, i: int) -> int:
        """The first token of the member expression that ends at i."""
        while i > 0:
            if i in self.opens:
                i = self.opens[i]
                if self.text(i) in ("(", "[") and (self.name(i - 1) and self.text(i - 1) not in KEYWORDS or self.text(i - 1) in (")", "]")):
                    i -= 1
                    continue
            if self.text(i - 1) in (".", "?."):
                i -= 2
                continue
            return i
        return max(i, 0)

    def imported(self, i: int) -> int:
        line, j, first = self.line(i), i + 1, len(self.found.imports)
        add = lambda local, name: self.found.imports.append({"local": local, "imported": name, "specifier": "", "line": line})
        if self.text(j) == "type" and self.text(j + 1) not in ("from", ","):
            j += 1
        while j < self.n and self.tokens[j].kind != "string":
            if self.text(j) == "*" and self.text(j + 1) == "as":
                add(self.text(j + 2), "*")
                j += 3
            elif self.text(j) == "{":
                for local, name in self.listed(j):
                    add(local, name)
                j = self.close[j] + 1
            elif self.name(j) and self.text(j) != "from":
                add(self.text(j), "default")
                j += 1
            elif self.text(j) in ("=", ";"):
                break
            else:
                j += 1
        if j < self.n and self.tokens[j].kind == "string":
            for x in self.found.imports[first:]:
                x["specifier"] = self.text(j)[1:-1]
        else:
            del self.found.imports[first:]
        return j + 1

    def listed(self, brace: int) -> list[tuple[str, str]]:
        """(alias or name, name) of `{ a, type b as c }`."""
        out, k = [], brace + 1
        while k < self.close[brace]:
            if self.text(k) == "type" and self.name(k + 1) and self.text(k + 1) != "as":
                k += 1
            if self.name(k):
                name, alias = self.text(k), self.text(k)
                if self.text(k + 1) == "as":
                    alias, k = self.text(k + 2), k + 2
                out.append((alias, name))
            k += 1
        return out

    def exported(self, i: int) -> int:
        """Notes what `export` at i exports; gives the place of the declaration behind it."""
        line, j = self.line(i), i + 1
        add = lambda name, local, source=None, star=False: self.found.exports.append({"exported": name, "local": local, "source": source, "star": star, "line": line})
        if self.text(j) == "type" and self.text(j + 1) in ("{", "*"):
            j += 1
        if self.text(j) == "*":
            if self.text(j + 1) == "as":
                add(self.text(j + 2), "*", self.text(j + 4)[1:-1])
                return j + 5
            add("*", None, self.text(j + 2)[1:-1], True)
            return j + 3
        if self.text(j) == "{":
            after = self.close[j] + 1
            source = self.text(after + 1)[1:-1] if self.text(after) == "from" else None
            for alias, name in self.listed(j):
                add(alias, name, source)
            return after + 2 if source is not None else after
        if self.text(j) == "default":
            k = j + 1
            while self.text(k) in ("async", "abstract", "function", "class", "*"):
                k += 1
            declared = self.text(k - 1) in ("function", "class", "*")
            plain = self.name(k) and self.text(k) not in KEYWORDS | {"extends", "implements"} and (declared or self.text(k + 1) in (";", "") or self.fresh_line(k + 1))
            add("default", self.text(k) if plain else "default")
            return j
        k = j
        while self.text(k) in ("declare", "abstract", "async"):
            k += 1
        if self.text(k) in ("const", "let", "var") and self.text(k + 1) != "enum":
            m = k + 1
            while m < self.n:
                if self.name(m):
                    add(self.text(m), self.text(m))
                end = self.statement_end(m, self.n)
                if self.text(end) != ",":
                    break
                m = end + 1
        else:
            k += self.text(k) == "const"
            m = k + 2 if self.text(k + 1) == "*" else k + 1
            if self.text(k) in ("function", "class", "interface", "type", "enum", "namespace", "module") and self.name(m):
                add(self.text(m), self.text(m))
        return j


def extract(path: str, content: bytes) -> tuple[str, list[dict], list[dict], list[dict], list[dict]]:
    """State, symbols, references, imports and exports of one file."""
    source = content.decode(errors="replace")
    try:
        scanner = Scanner(source)
        scanner.code(0, scanner.n, [], True)
    except (ValueError, IndexError, KeyError, RecursionError):
        return "failed", [], [], [], []
    found = scanner.found
    wide = [0]
    for c in source:
        wide.append(wide[-1] + len(c.encode(errors="replace")))
    test, groups, rows = is_test(path), {}, []
    order = sorted(range(len(found.symbols)), key=lambda k: (found.symbols[k]["start"], -found.symbols[k]["end"]))
    for k in order:
        groups.setdefault(".".join(found.symbols[k]["chain"]), []).append(k)
    keys = {}
    for chain, group in groups.items():
        seen: dict[str, int] = {}
        for k in group:
            mark = hashlib.sha256(found.symbols[k]["signature"].encode()).hexdigest()[:8]
            seen[mark] = seen.get(mark, 0) + 1
            keys[k] = f"ts:{path}#{chain}" + ("" if len(group) == 1 else f"~{mark}" + (f"~{seen[mark]}" if seen[mark] > 1 else ""))
    open_: list[tuple[int, bool]] = []  # what an exported declaration holds is exported
    for k in order:
        s = found.symbols[k]
        while open_ and open_[-1][0] <= s["start"]:
            open_.pop()
        s["exported"] = s["exported"] or bool(open_ and open_[-1][1])
        open_.append((s["end"], s["exported"]))
    for k in order:
        s = found.symbols[k]
        body = source[s["start"] : s["end"]]
        rows.append({
            "stable_key": keys[k], "qualified_name": ".".join(s["chain"]), "short_name": s["chain"][-1], "kind": s["kind"], "signature": s["signature"], "start_byte": wide[s["start"]], "end_byte": wide[s["end"]],
            "start_line": bisect_left(scanner.lines, s["start"]) + 1, "end_line": bisect_left(scanner.lines, s["end"]) + 1, "body_hash": hashlib.sha256(body.encode()).hexdigest(), "exported": s["exported"], "is_test": test,
        })
    refs, inside, waiting = [], [], list(reversed(order))
    for r in sorted(found.refs, key=lambda r: r["at"]):
        while waiting and found.symbols[waiting[-1]]["start"] <= r["at"]:
            inside.append(waiting.pop())
        while inside and found.symbols[inside[-1]]["end"] <= r["at"]:
            inside.pop()
        own = inside[-1] if inside else None  # symbols nest, so the last one open is the innermost
        column = r["at"] - (source.rfind("\n", 0, r["at"]) + 1)
        refs.append({"from_key": f"ts:{path}#" if own is None else keys[own], "name": r["name"], "receiver": r["receiver"], "receiver_type": None, "kind": r["kind"], "site_line": r["line"], "site_column": column})
    imports = [{"local": x["local"], "imported": x["imported"], "specifier": x["specifier"], "site_line": x["line"]} for x in found.imports]
    exports = [{"exported": x["exported"], "local": x["local"], "source": x["source"], "star": x["star"], "site_line": x["line"]} for x in found.exports]
    return "ok", rows, refs, imports, exports
