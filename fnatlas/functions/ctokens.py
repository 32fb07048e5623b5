"""A tokenizer and statement parser for C, enough to find functions and to count what they consist of."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Words that can't name a function.
KEYWORDS = frozenset("if else for while do switch case default return goto break continue sizeof typedef struct union enum static extern const volatile inline register auto".split())
#: Words that begin a declaration.
TYPE_WORDS = frozenset("void char short int long float double signed unsigned _Bool bool struct union enum static extern const volatile register auto typedef size_t ssize_t".split())
ASSIGNMENTS = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="))

_TOKEN = re.compile(
    r"""(?P<directive>(?:(?<=\n)|\A)[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*)
    |(?P<skip>\n|[^\S\n]+|//(?:[^\\\n]|\\.|\\\n)*|/\*.*?(?:\*/|\Z))
    |(?P<string>L?"(?:[^"\\\n]|\\.|\\\n)*"?|L?'(?:[^'\\\n]|\\.)*'?)
    |(?P<name>[^\W\d]\w*)
    |(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)
    |(?P<op><<=|>>=|\.\.\.|->|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|>>|.)""",
    re.VERBOSE | re.DOTALL,
)


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def tokens(code: str) -> list[Token]:
    """The tokens but for space and comments; a preprocessor line is one token."""
    out, at = [], 0
    while at < len(code):
        m = _TOKEN.match(code, at)
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], m.start(), m.end()))
        at = m.end()
    return out


class Function(NamedTuple):
    name: str
    start: int
    end: int


def functions(code: str) -> list[Function]:
    """Function definitions outside braces, but for those in `extern "C" { }`: name, and where they start and end."""
    toks = [t for t in tokens(code)]
    out, i, start, n = [], 0, 0, len(toks)
    while i < n:
        t = toks[i]
        if t.kind == "directive" or t.text in (";", "}"):
            i += 1
            start = i
        elif t.text == "{":
            head = toks[start:i]
            name = _declared(head)
            if not name and len(head) == 2 and head[0].text == "extern" and head[1].kind == "string":
                i += 1
                start = i
                continue
            close = _closing(toks, i, "{", "}")
            if name and close < n:
                out.append(Function(name, head[0].start, toks[close].end))
            i = close + 1
            # a function ends here; other braces may go on to their semicolon
            if name or not any(x.text == "=" for x in head):
                start = i
        else:
            i += 1
    return out


def _closing(toks: list[Token], at: int, opening: str, closing: str) -> int:
    depth = 0
    for j in range(at, len(toks)):
        if toks[j].text == opening:
            depth += 1
        elif toks[j].text == closing:
            depth -= 1
            if not depth:
                return j
    return len(toks)


def _declared(head: list[Token]) -> str | None:
    """The name that a head declares as a function: a name before the first parenthesis outside any, behind its type."""
    for j, t in enumerate(head):
        if t.text == "=":
            return None
        if t.text == "(":
            if not j or head[j - 1].kind != "name" or head[j - 1].text in KEYWORDS:
                return None
            if head[j - 1].text in ("__attribute__", "__declspec"):
                close = _closing(head, j, "(", ")")
                rest = _declared(head[close + 1 :])
                return rest
            close = _closing(head, j, "(", ")")
            after = head[close + 1 :]
            if close >= len(head) or (after and after[0].text not in ("__attribute__",) and not (after[0].kind == "name" and all(x.kind in ("name", "op") and x.text not in ("=", ";") for x in after))):
                return None
            return head[j - 1].text if j > 1 or len(head) > close else None
    return None


class Shape(NamedTuple):
    """What a function consists of."""

    counts: dict[str, int]
    loops: int
    branches: int
    cyclomatic: int


#: The statements and expressions that are counted, in the order of the features.
COUNTED = (
    "assignment", "declaration", "call", "return", "if", "for", "while", "do", "switch", "goto", "break", "continue",
)


class _Parser:
    def __init__(self, toks: list[Token]) -> None:
        self.toks, self.i = toks, 0
        self.counts = dict.fromkeys(COUNTED, 0)
        self.deep = [0, 0]
        self.paths = 1

    def text(self, k: int = 0) -> str:
        j = self.i + k
        return self.toks[j].text if j < len(self.toks) else ""

    def statement(self, loops: int, branches: int) -> None:
        self.deep = [max(self.deep[0], loops), max(self.deep[1], branches)]
        t = self.text()
        if t == "{":
            self.i += 1
            while self.i < len(self.toks) and self.text() != "}":
                self.statement(loops, branches)
            self.i += 1
        elif t in ("if", "while", "switch", "for"):
            self.counts[t] += 1
            self.paths += t != "switch"
            self.i += 1
            self.parenthesis(t == "for")
            inner = (loops + 1, branches) if t in ("for", "while") else (loops, branches + 1)
            self.statement(*inner)
            if t == "if" and self.text() == "else":
                self.i += 1
                self.statement(*inner)
        elif t == "else":
            self.i += 1
        elif t == "do":
            self.counts["do"] += 1
            self.paths += 1
            self.i += 1
            self.statement(loops + 1, branches)
            if self.text() == "while":
                self.i += 1
                self.parenthesis(False)
            self.past(";")
        elif t in ("case", "default"):
            self.paths += 1
            self.i += 1
            while self.i < len(self.toks) and self.text() not in (":", ";", "}"):
                self.operator()
                self.i += 1
            self.i += self.text() == ":"
        elif t in ("return", "goto", "break", "continue"):
            self.counts[t] += 1
            self.i += 1
            self.expression((";",))
        elif self.i < len(self.toks) and self.toks[self.i].kind == "directive":
            self.i += 1
        elif self.i < len(self.toks) and self.toks[self.i].kind == "name" and self.text(1) == ":" and t not in KEYWORDS:
            self.i += 2
        elif self.declares():
            self.counts["declaration"] += 1
            self.declaration()
        else:
            self.expression((";",))

    def declares(self) -> bool:
        t = self.toks[self.i] if self.i < len(self.toks) else None
        if t is None or t.kind != "name":
            return False
        if t.text in TYPE_WORDS:
            return True
        k = 1
        while self.text(k) == "*":
            k += 1
        nxt = self.toks[self.i + k] if self.i + k < len(self.toks) else None
        return t.text not in KEYWORDS and nxt is not None and nxt.kind == "name" and (k == 1 or self.text(k + 1) in ("=", ";", ",", "["))

    def declaration(self) -> None:
        """Up to the semicolon; `=` outside parentheses and brackets is no assignment here."""
        depth = 0
        while self.i < len(self.toks):
            t = self.text()
            if t in "([{" and t:
                depth += 1
            elif t in ")]}" and t:
                if t == "}" and not depth:
                    return
                depth -= 1
            elif t == ";" and depth <= 0:
                self.i += 1
                return
            if t != "=" or depth:
                self.operator()
            self.i += 1

    def operator(self) -> None:
        t = self.toks[self.i]
        if t.text in ASSIGNMENTS:
            self.counts["assignment"] += 1
        elif t.text in ("&&", "||", "?"):
            self.paths += 1
        elif t.kind == "name" and t.text not in KEYWORDS and t.text not in TYPE_WORDS and self.text(1) == "(":
            self.counts["call"] += 1

    def expression(self, ends: tuple[str, ...]) -> None:
        depth = 0
        while self.i < len(self.toks):
            t = self.text()
            if depth <= 0 and (t in ends or t == "}"):
                self.i += t in ends
                return
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            self.operator()
            self.i += 1

    def parenthesis(self, loop: bool) -> None:
        if self.text() != "(":
            return
        self.i += 1
        if loop and self.declares():
            self.counts["declaration"] += 1
            self.declaration()
        depth = 1
        while self.i < len(self.toks):
            t = self.text()
            depth += (t == "(") - (t == ")")
            if not depth:
                self.i += 1
                return
            self.operator()
            self.i += 1

    def past(self, text: str) -> None:
        self.i += self.text() == text


def shape(code: str) -> Shape:
    toks = tokens(code)
    body = next((i for i, t in enumerate(toks) if t.text == "{"), len(toks))
    p = _Parser([t for t in toks[body:] if t.kind != "directive"])
    while p.i < len(p.toks):
        before = p.i
        p.statement(0, 0)
        p.i += p.i == before
    return Shape(p.counts, p.deep[0], p.deep[1], p.paths)


AST_NAMES = (*(f"{c}_ratio" for c in COUNTED), "loop_depth_norm", "branch_depth_norm", "cyclomatic_norm")


def ast_features(code: str | None) -> list[float]:
    s = shape(code or "")
    total = sum(s.counts.values()) or 1
    return [s.counts[c] / total for c in COUNTED] + [min(s.loops / 5, 1.0), min(s.branches / 5, 1.0), min(s.cyclomatic / 20, 1.0)]
