"""Code lexing: blanking of comments and literals, tokens, shapes, and function extraction."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: After these words a slash starts a regular expression.
REGEX_WORDS = frozenset("return typeof instanceof in of new delete void case do else yield await throw".split())
#: Words that never name a function.
NOT_NAMES = frozenset(
    "function if for while switch catch return do else new typeof instanceof in of case delete void await yield throw class extends super this import export default const let var try finally null true false undefined async get set static public private protected readonly declare abstract override enum interface type namespace module from as satisfies keyof infer is asserts require with debugger".split()
)
#: What may stand before a member's name.
MEMBER_PREVIOUS = frozenset("{ } ; , * public private protected static readonly abstract override declare async get set export default".split())
#: A lone one of these after an arrow is a type, not a body.
TYPE_WORDS = frozenset("void string number boolean any unknown never object symbol bigint".split())
#: A line that starts so after a complete expression starts a statement.
STATEMENT_WORDS = frozenset("const let var return if for while function class export import switch try throw do else interface type enum".split())
#: Longest body of an arrow without braces.
EXPRESSION_TOKENS = 400

_OPEN, _CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Token:
    v: str
    line: int
    kind: str


@dataclass(frozen=True)
class Function:
    name: str
    line: int
    kind: str
    tokens: tuple[Token, ...]


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _literal(text: str) -> str:
    return "0" + "\n" * text.count("\n")


_JS = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'?|"(?:\\.|[^"\\\n])*"?)|(?P<template>`)|(?P<slash>/)""", re.S)
_JS_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"\\.|\$\{|`", re.S)
_RUST = re.compile(r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>\bb?c?r(?P<hashes>\#*)".*?(?:"(?P=hashes)|\Z))|(?P<string>"(?:\\.|[^"\\])*"?)|(?P<char>'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')""", re.S)
_TOKEN = re.compile(r"(?P<id>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<num>[0-9][0-9A-Za-z_.]*)|[\n \t\r\f\v]|(?P<punct>.)", re.S)


_IN_CODE = re.compile(r"[{}`'\"]")


def _template_end(code: str, at: int) -> int:
    """Past the backtick that closes a template whose text starts at ``at``; substitutions and templates may nest."""
    depths = [0]  # of braces in each open template; 0 is its text
    while m := (_IN_CODE if depths[-1] else _TEMPLATE).search(code, at):
        at = m.end()
        if not depths[-1]:
            if m[0] == "`":
                depths.pop()
                if not depths:
                    return at
            elif m[0] == "${":
                depths[-1] = 1
        elif m[0] == "`":
            depths.append(0)
        elif m[0] in "'\"":
            at = _JS.match(code, m.start()).end()
        else:
            depths[-1] += 1 if m[0] == "{" else -1
    return len(code)


def mask(code: str, lang: str = "js") -> str:
    """code with comments blank and literals as 0; lines stay."""
    return _mask_rust(code) if lang == "rust" else _mask_js(code)


def _mask_js(code: str) -> str:
    out, at, before = [], 0, ""  # before: the end of the output up to its last sign that isn't blank
    while m := _JS.search(code, at):
        plain = code[at : m.start()]
        out.append(plain)
        before = _tail(before, plain)
        end = m.end()
        if m["comment"]:
            out.append(_blank(m[0]))
        elif m["slash"]:
            found = _JS_REGEX.match(code, m.start()) if _regex_may_start(before) else None
            out.append("0" if found else "/")
            end = found.end() if found else end
            before = out[-1]
        else:
            end = _template_end(code, end) if m["template"] else end
            out.append(_literal(code[m.start() : end]))
            before = _tail(before, "0")
        at = end
    return "".join(out) + code[at:]


def _tail(before: str, more: str) -> str:
    """What decides about a slash after before and more: the last word, or the last sign; blanks behind a word end it."""
    kept = more.rstrip()
    if not kept:
        return before + " " if more and not before.endswith(" ") else before
    word = re.search(r"[A-Za-z0-9_$]+$", kept)
    joined = before if word and len(word[0]) == len(kept) else ""
    return joined + (word[0] if word else kept[-1]) + (" " if len(kept) < len(more) else "")


def _regex_may_start(before: str) -> bool:
    before = before.rstrip()
    if word := re.search(r"[A-Za-z0-9_$]+$", before):
        return word[0] in REGEX_WORDS
    return not before.endswith((")", "]"))


def _mask_rust(code: str) -> str:
    out, at = [], 0
    while m := _RUST.search(code, at):
        out.append(code[at : m.start()])
        end = m.end()
        if m["block"]:  # block comments nest
            depth = 1
            while depth and (edge := re.compile(r"/\*|\*/").search(code, end)):
                depth += 1 if edge[0] == "/*" else -1
                end = edge.end()
            end = len(code) if depth else end
        out.append(_blank(code[m.start() : end]) if m["block"] or m["line"] else _literal(code[m.start() : end]))
        at = end
    return "".join(out) + code[at:]


def tokenise(masked: str) -> list[Token]:
    """Identifiers, numbers and single punctuation units, with lines from 1; an astral character is two units."""
    out, line = [], 1
    for m in _TOKEN.finditer(masked):
        if m[0] == "\n":
            line += 1
        elif m.lastgroup:
            units = [m[0]] if m.lastgroup != "punct" or m[0] < "\U00010000" else [chr(0xD800 + (ord(m[0]) - 0x10000 >> 10)), chr(0xDC00 + (ord(m[0]) & 0x3FF))]
            out += [Token(u, line, m.lastgroup) for u in units]
    return out


class _Cursor:
    """Bracket-aware steps over tokens."""

    def __init__(self, tokens: list[Token]):
        self.t = tokens
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, x in enumerate(tokens):
            if x.v in _OPEN:
                stack.append(i)
            elif x.v in _CLOSE and stack:
                if _OPEN.index(tokens[stack[-1]].v) == _CLOSE.index(x.v):
                    self.partner[stack.pop()] = i

    def v(self, i: int) -> str:
        return self.t[i].v if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id" and self.v(i) not in NOT_NAMES

    def past_generics(self, i: int, stop: str = ";{}") -> int:
        """Past <...> at i, or i; -1 if it does not close."""
        if self.v(i) != "<":
            return i
        depth = 0
        for j in range(i, len(self.t)):
            if self.v(j) == "<":
                depth += 1
            elif self.v(j) == ">" and self.v(j - 1) not in "-=":
                depth -= 1
                if not depth:
                    return j + 1
            elif self.v(j) in stop:
                return -1
        return -1

    def past_parameters(self, i: int) -> int:
        """Past (...) at i, or -1."""
        return self.partner[i] + 1 if self.v(i) == "(" and i in self.partner else -1

    def block(self, i: int) -> tuple[Token, ...] | None:
        """The inside of a body that opens at i or after a return type."""
        while i < len(self.t) and self.v(i) != "{":
            if self.v(i) in (";", "=", "}", ")", ",") or i in self.partner and self.v(i) == "(" and self.v(i - 1) != ":":
                return None
            i = self.partner.get(i, i) + 1
        return tuple(self.t[i + 1 : self.partner[i]]) if i in self.partner else None

    def arrow_body(self, i: int) -> tuple[Token, ...]:
        """The body of an arrow function that starts at i: a block, or an expression to its end."""
        if self.v(i) == "{" and i in self.partner:
            return tuple(self.t[i + 1 : self.partner[i]])
        j = i
        while j < len(self.t) and j - i < EXPRESSION_TOKENS:
            x = self.t[j]
            if x.v in ",;" or x.v in _CLOSE or j > i and x.v in STATEMENT_WORDS and x.line > self.t[j - 1].line:
                break
            j = self.partner.get(j, j) + 1
        return tuple(self.t[i : min(j, i + EXPRESSION_TOKENS)])

    def value(self, i: int) -> tuple[str, tuple[Token, ...]] | None:
        """Kind and body of a function value at i."""
        prefix = "async-" if self.v(i) == "async" else ""
        i += bool(prefix)
        if self.v(i) == "function":
            i += 1 + (self.v(i + 1) == "*")
            i += self.v(i) != "("
            end = self.past_parameters(i)
            body = self.block(end) if end > 0 else None
            return None if body is None else ("function-expression", body)
        if self.is_name(i) and self.v(i + 1) == "=" and self.v(i + 2) == ">":
            return f"{prefix}arrow", self.arrow_body(i + 3)
        end = self.past_parameters(self.past_generics(i))
        while 0 < end < len(self.t) and not (self.v(end) == "=" and self.v(end + 1) == ">"):
            if self.v(end) in (";", "{", "}", ")", ",", "="):
                return None
            end = self.partner.get(end, end) + 1
        return (f"{prefix}arrow", self.arrow_body(end + 2)) if 0 < end < len(self.t) else None

    def assignment(self, i: int) -> int:
        """The = of a declaration whose name ends before i, past a type annotation; or -1."""
        depth = 0
        while i < len(self.t):
            v = self.v(i)
            if v == "=" and not depth and self.v(i + 1) != ">":
                return -1 if self.v(i + 1) == "=" else i
            if v in _CLOSE or v == ";" and not depth:
                return -1
            depth += (v == "<") - (v == ">" and self.v(i - 1) not in "-=")
            i = self.partner.get(i, i) + 1
        return -1


def extract(source: str, lang: str = "js") -> list[Function]:
    """Every function-like declaration, in order: functions, function values of declarations and members, methods; for Rust fn items."""
    c = _Cursor(tokenise(mask(source, lang)))
    out: list[Function] = []

    def add(i: int, kind: str, body: tuple[Token, ...] | None) -> None:
        if body:
            out.append(Function(c.v(i), c.t[i].line, kind, body))

    for i, t in enumerate(c.t):
        if lang == "rust":
            if t.v == "fn" and i + 1 < len(c.t) and c.t[i + 1].kind == "id":
                end = c.past_parameters(c.past_generics(i + 2))
                j = end
                while 0 < j < len(c.t) and c.v(j) not in ";{":
                    j = c.partner.get(j, j) + 1
                if 0 < j < len(c.t) and c.v(j) == "{" and j in c.partner:
                    add(i + 1, "fn", tuple(c.t[j + 1 : c.partner[j]]))
        elif t.v == "function":
            j = i + 1 + (c.v(i + 1) == "*")
            if c.is_name(j):
                end = c.past_parameters(c.past_generics(j + 1))
                add(j, "function", c.block(end) if end > 0 else None)
        elif t.v in ("const", "let", "var"):
            if c.is_name(i + 1) and (eq := c.assignment(i + 2)) > 0 and (found := c.value(eq + 1)):
                add(i + 1, *found)
        elif c.is_name(i) and (not i or c.v(i - 1) in MEMBER_PREVIOUS or c.t[i - 1].line < t.line and c.v(i - 1) not in ".=(:?"):
            if c.v(i + 1) in (":", "=") and c.v(i + 2) != "=" and (found := c.value(i + 2)) and not (len(found[1]) == 1 and found[1][0].v in TYPE_WORDS):
                add(i, f"property-{found[0]}", found[1])
            end = c.past_parameters(c.past_generics(i + 1))
            add(i, "method", c.block(end) if end > 0 else None)
    return out


def shape(tokens: tuple[Token, ...]) -> list[str]:
    return [{"id": "ID", "num": "NUM"}.get(t.kind, t.v) for t in tokens]
