"""Reading Elixir source: a tokenizer and a precedence parser to a uniform tree.

Every syntax element is a ``Node`` with its kind, line, column and span in the text:
    int float str charlist atom sigil      literals (``value``; sigils have ``name``)
    interp                                 a string with interpolation (``args`` are its parts)
    list tuple map struct bits             containers; a keyword pair is a tuple whose first element is an atom
    var alias                              ``name``
    call                                   ``name(args)``, operators and special forms included; ``target`` for
                                           ``target.name(args)``; a do block is a last argument: a list of pairs
    fn clause block                        clauses have ``args`` (patterns) and ``body``
``walk`` yields nodes in pre-order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator


class ParseError(Exception):
    def __init__(self, line: int, token: str, why: str = "syntax error before"):
        super().__init__(f"{why}: {token}")
        self.line, self.token, self.why = line, token, why


class Node:
    __slots__ = ("args", "body", "col", "end", "flags", "kind", "line", "name", "start", "target", "value")

    def __init__(self, kind: str, line: int, col: int, start: int, end: int = 0, name: str | None = None, args: list[Node] | None = None, value=None, target: Node | None = None, body: Node | None = None, flags: str = ""):
        self.kind, self.line, self.col, self.start, self.end = kind, line, col, start, end
        self.name, self.args, self.value, self.target, self.body, self.flags = name, args if args is not None else [], value, target, body, flags

    def children(self) -> list[Node]:
        out = [self.target] if self.target is not None else []
        out += self.args
        return out + [self.body] if self.body is not None else out

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children()))

    def shape(self) -> tuple:
        """What the node is, without where it is."""
        return (self.kind, self.name, repr(self.value), *(c.shape() for c in self.children()))

    def __repr__(self) -> str:
        inside = ", ".join(map(repr, self.children()))
        return f"{self.kind}:{self.name or ''}{'' if self.value is None else repr(self.value)}({inside})"


class Token:
    __slots__ = ("col", "end", "kind", "line", "spaced", "start", "value")

    def __init__(self, kind: str, value, line: int, col: int, start: int, end: int, spaced: bool):
        self.kind, self.value, self.line, self.col, self.start, self.end, self.spaced = kind, value, line, col, start, end, spaced

    def __repr__(self) -> str:
        return f"{self.kind}:{self.value}"


#: Fixed values of the language: operators by length, and keywords.
OPERATORS = [
    "<<<", ">>>", "|||", "&&&", "^^^", "~~~", "===", "!==", "<~>", "<|>", "<<~", "~>>", "...", "+++", "---",
    "<<", ">>", "|>", "->", "<-", "=>", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "<>", "..", "//", "::", "\\\\", "=~", "~>", "<~", "**",
    "+", "-", "*", "/", "=", "<", ">", "|", "&", "@", "^", "!", ".", ",", "(", ")", "[", "]", "{", "}", "%", ";",
]
RESERVED = {"do", "end", "fn", "after", "else", "rescue", "catch", "true", "false", "nil", "and", "or", "not", "in", "when"}
BLOCK_WORDS = ("after", "else", "rescue", "catch")
#: Binary operators: precedence, and whether they associate to the right.
BINARY = {
    "<-": (1, False), "\\\\": (1, False), "when": (2, True), "::": (3, True), "|": (4, True), "=>": (5, True), "=": (7, True),
    "||": (8, False), "|||": (8, False), "or": (8, False), "&&": (9, False), "&&&": (9, False), "and": (9, False),
    "==": (10, False), "!=": (10, False), "=~": (10, False), "===": (10, False), "!==": (10, False),
    "<": (11, False), ">": (11, False), "<=": (11, False), ">=": (11, False),
    "|>": (12, False), "<<<": (12, False), ">>>": (12, False), "<<~": (12, False), "~>>": (12, False), "<~": (12, False), "~>": (12, False), "<~>": (12, False), "<|>": (12, False),
    "in": (13, False), "not in": (13, False), "^^^": (14, False), "//": (15, True),
    "++": (16, True), "--": (16, True), "+++": (16, True), "---": (16, True), "..": (16, True), "<>": (16, True),
    "+": (17, False), "-": (17, False), "*": (18, False), "/": (18, False), "**": (19, False),
}
UNARY = {"+": 20, "-": 20, "!": 20, "^": 20, "not": 20, "~~~": 20, "&": 6, "@": 22}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "s": " ", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v", "d": "\x7f"}
_IDENT = re.compile(r"[^\W\dA-Z]\w*[?!]?", re.UNICODE)
_ALIAS = re.compile(r"[A-Z]\w*")
_NUMBER = re.compile(r"0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*")
_ATOM = re.compile(r":(?:[^\W\d]\w*(?:@\w+)*[?!]?|<<>>|%\{\}|\{\}|\.\.//|\.\.\.|&&&|\|\|\||===|!==|<<<|>>>|\|>|<>|\+\+|--|==|!=|<=|>=|&&|\|\||\.\.|=~|->|<-|::|[+\-*/=<>|&@^!.%])", re.UNICODE)
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}


class Lexer:
    def __init__(self, text: str, line: int = 1):
        self.text, self.at, self.line, self.bol = text, 0, line, 0
        self.tokens: list[Token] = []
        self.base = 0

    def error(self, token: str, why: str = "syntax error before") -> ParseError:
        return ParseError(self.line, token, why)

    def add(self, kind: str, value, start: int, spaced: bool, line: int | None = None, bol: int | None = None) -> None:
        self.tokens.append(Token(kind, value, line or self.line, start - (self.bol if bol is None else bol) + 1, start, self.at, spaced))

    def run(self) -> list[Token]:
        text, n = self.text, len(self.text)
        spaced = False
        while self.at < n:
            c = text[self.at]
            start = self.at
            if c in " \t\r":
                self.at += 1
                spaced = True
                continue
            if c == "\\" and text[self.at + 1 : self.at + 2] == "\n":
                self.at += 2
                self.line += 1
                self.bol = self.at
                spaced = True
                continue
            if c == "#":
                stop = text.find("\n", self.at)
                self.at = n if stop < 0 else stop
                spaced = True
                continue
            if c == "\n":
                self.at += 1
                if not self.tokens or self.tokens[-1].kind != "eol":
                    self.add("eol", "\n", start, spaced)
                self.line += 1
                self.bol = self.at
                spaced = True
                continue
            self.one(c, start, spaced)
            spaced = False
        self.add("eof", "", self.at, spaced)
        return self.tokens

    def one(self, c: str, start: int, spaced: bool) -> None:
        text = self.text
        line, bol = self.line, self.bol
        if c.isdigit():
            m = _NUMBER.match(text, start)
            self.at = m.end()
            raw = m[0].replace("_", "")
            after = text[self.at : self.at + 1]
            if after.isalnum():
                raise self.error(f'"{text[start : self.at + 1]}"', "invalid character after number")
            if raw[:2] in ("0x", "0o", "0b"):
                self.add("int", int(raw, 0), start, spaced)
            elif "." in raw:
                self.add("float", float(raw), start, spaced)
            else:
                self.add("int", int(raw), start, spaced)
            return
        if c == "?" and self.at + 1 < len(text) and not (text[self.at + 1].isspace() and text[self.at + 1] != " "):
            if text[self.at + 1] == "\\":
                value, self.at = self.escape(self.at + 1)
                self.add("int", ord(value[0]) if value else 0, start, spaced)
            else:
                self.at += 2
                self.add("int", ord(text[start + 1]), start, spaced)
            return
        if c in "\"'":
            heredoc = text.startswith(c * 3, start)
            parts = self.quoted(c * 3 if heredoc else c, c * 3 if heredoc else c, heredoc, True)
            if text[self.at : self.at + 1] == ":" and text[self.at + 1 : self.at + 2] in (" ", "\n", "\t") and not heredoc:
                self.at += 1
                self.add("key", parts, start, spaced, line, bol)
            else:
                kind = "str" if c == '"' else "charlist"
                self.add(kind + ("_heredoc" if heredoc else ""), parts, start, spaced, line, bol)
            return
        if c == "~" and (m := re.compile(r"~([a-z]|[A-Z][A-Z0-9]*)").match(text, start)) and text[m.end() : m.end() + 1] in "/|\"'([{<":
            name, self.at = m[1], m.end()
            opener = text[self.at]
            heredoc = opener in "\"'" and text.startswith(opener * 3, self.at)
            first = opener * 3 if heredoc else opener
            last = first if heredoc else _CLOSE.get(opener, opener)
            parts = self.quoted(first, last, heredoc, name[0].islower(), raw=True)
            mods = re.compile(r"[a-zA-Z]*").match(text, self.at)[0]
            self.at += len(mods)
            self.add("sigil", (name, parts, mods), start, spaced, line, bol)
            return
        if c == ":":
            if text.startswith(':"', start) or text.startswith(":'", start):
                self.at += 1
                parts = self.quoted(text[self.at], text[self.at], False, True)
                self.add("atom", parts, start, spaced, line, bol)
                return
            if not text.startswith("::", start) and (m := _ATOM.match(text, start)):
                self.at = m.end()
                self.add("atom", m[0][1:], start, spaced)
                return
        if m := _IDENT.match(text, start):
            word = m[0]
            self.at = m.end()
            # `x!=y` and `x?` before a key's colon
            if word[-1] in "?!" and text[self.at : self.at + 1] == "=" and text[self.at + 1 : self.at + 2] not in "=~>" and word[-1] == "!":
                word, self.at = word[:-1], self.at - 1
            if text[self.at : self.at + 1] == ":" and text[self.at + 1 : self.at + 2] != ":" and text[self.at + 1 : self.at + 2] in (" ", "\n", "\t", ")", ",", "]", ""):
                self.at += 1
                self.add("key", word, start, spaced)
                return
            self.add("word" if word in RESERVED and not self.after_dot() else "ident", word, start, spaced)
            return
        if m := _ALIAS.match(text, start):
            self.at = m.end()
            if text[self.at : self.at + 1] == ":" and text[self.at + 1 : self.at + 2] in (" ", "\n", "\t"):
                self.at += 1
                self.add("key", m[0], start, spaced)
                return
            self.add("alias", m[0], start, spaced)
            return
        for op in OPERATORS:
            if text.startswith(op, start):
                self.at += len(op)
                if text[self.at : self.at + 1] == ":" and text[self.at + 1 : self.at + 2] in (" ", "\n") and op not in "()[]{},;.":
                    self.at += 1
                    self.add("key", op, start, spaced)
                    return
                self.add("eol" if op == ";" else "op", op, start, spaced)
                return
        raise self.error(f'"{c}"', "unexpected token")

    def after_dot(self) -> bool:
        return bool(self.tokens) and self.tokens[-1].kind == "op" and self.tokens[-1].value == "."

    def escape(self, at: int) -> tuple[str, int]:
        c = self.text[at + 1 : at + 2]
        if c == "x" or c == "u":
            if m := re.compile(r"\{([0-9a-fA-F]+)\}|([0-9a-fA-F]{4})|([0-9a-fA-F]{1,2})").match(self.text, at + 2):
                return chr(int(m[1] or m[2] or m[3], 16)), m.end()
        if c == "\n":
            self.line += 1
            self.bol = at + 2
            return "", at + 2
        return _ESCAPES.get(c, c), at + 2

    def quoted(self, opener: str, closer: str, heredoc: bool, interpolates: bool, raw: bool = False) -> list:
        """Parts of a quoted text (strings, and token lists of interpolations); leaves ``at`` behind the closer."""
        text, line0 = self.text, self.line
        self.at += len(opener)
        parts: list = []
        buf: list[str] = []
        indent = 0
        if heredoc:
            stop = text.find("\n", self.at)
            close = re.compile(r"^([ \t]*)" + re.escape(closer), re.M).search(text, self.at if stop < 0 else stop)
            if stop < 0 or not close:
                raise ParseError(line0, closer, "missing terminator")
            indent = len(close[1])
            self.at = stop + 1
            self.line += 1
            self.bol = self.at
            self.at += self.skip_indent(indent)
        while True:
            if self.at >= len(text):
                raise ParseError(line0, closer, "missing terminator")
            if text.startswith(closer, self.at) and (not heredoc or not text[self.bol : self.at].strip()):
                self.at += len(closer)
                break
            c = text[self.at]
            if c == "\\" and self.at + 1 < len(text):
                if raw:
                    if text[self.at + 1] == "\n":
                        self.line += 1
                        self.bol = self.at + 2
                    buf.append(text[self.at : self.at + 2])
                    self.at += 2
                else:
                    value, self.at = self.escape(self.at)
                    buf.append(value)
                continue
            if c == "#" and interpolates and text.startswith("#{", self.at):
                if buf:
                    parts.append("".join(buf))
                    buf = []
                parts.append(self.interpolation())
                continue
            buf.append(c)
            self.at += 1
            if c == "\n":
                self.line += 1
                self.bol = self.at
                if heredoc:
                    self.at += self.skip_indent(indent)
        if buf or not parts:
            parts.append("".join(buf))
        return parts

    def skip_indent(self, indent: int) -> int:
        n = 0
        while n < indent and self.text[self.at + n : self.at + n + 1] in (" ", "\t") and self.text[self.at + n : self.at + n + 1]:
            n += 1
        return n

    def interpolation(self) -> list[Token]:
        """Tokens between #{ and its }."""
        inner = Lexer(self.text, self.line)
        inner.at, inner.bol = self.at + 2, self.bol
        depth, spaced = 0, False
        while True:
            if inner.at >= len(self.text):
                raise ParseError(self.line, "}", "missing terminator")
            c, start = inner.text[inner.at], inner.at
            if c in " \t\r":
                inner.at += 1
                spaced = True
            elif c == "\n":
                inner.at += 1
                inner.add("eol", "\n", start, spaced)
                inner.line += 1
                inner.bol = inner.at
            elif c == "#":
                stop = inner.text.find("\n", inner.at)
                inner.at = len(inner.text) if stop < 0 else stop
            elif c == "}" and not depth:
                inner.at += 1
                break
            else:
                depth += (c == "{") - (c == "}")
                inner.one(c, start, spaced)
                spaced = False
        inner.add("eof", "", inner.at, spaced)
        self.at, self.line, self.bol = inner.at, inner.line, inner.bol
        return inner.tokens


#: Tokens that can begin an argument of a call without parentheses.
_STARTS = {"int", "float", "str", "str_heredoc", "charlist", "charlist_heredoc", "sigil", "atom", "ident", "alias", "key"}
_START_WORDS = {"fn", "true", "false", "nil", "not"}


class Parser:
    def __init__(self, tokens: list[Token], text: str):
        self.tokens, self.text, self.i = tokens, text, 0
        self.no_do = 0  # depth of contexts whose `do` belongs to an outer call

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.tokens[self.i]
        self.i += 1
        return t

    def is_op(self, *ops: str) -> bool:
        return self.now.kind == "op" and self.now.value in ops

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "word" and self.now.value in words

    def fail(self, t: Token | None = None) -> ParseError:
        t = t or self.now
        return ParseError(t.line, "" if t.kind == "eof" else str(t.value).replace("\n", "\\n"))

    def expect(self, op: str) -> Token:
        if not self.is_op(op):
            raise self.fail()
        return self.next()

    def skip_eol(self) -> None:
        while self.now.kind == "eol":
            self.i += 1

    def node(self, kind: str, t: Token | Node, **more) -> Node:
        n = Node(kind, t.line, t.col, t.start, **more)
        n.end = self.tokens[self.i - 1].end if self.i else t.end
        return n

    # -- expressions

    def program(self) -> Node:
        first = self.now
        out = self.statements(lambda: self.now.kind == "eof")
        if self.now.kind != "eof":
            raise self.fail()
        return self.blocked(out, first)

    def blocked(self, out: list[Node], first: Token) -> Node:
        if len(out) == 1:
            return out[0]
        return self.node("block", out[0] if out else first, args=out)

    def statements(self, done) -> list[Node]:
        out = []
        self.skip_eol()
        while not done():
            out.append(self.expr())
            if done():
                break
            if self.now.kind != "eol":
                raise self.fail()
            self.skip_eol()
        return out

    def expr(self, least: int = 0) -> Node:
        left = self.unary(least)
        while True:
            t = self.now
            if t.kind == "eol":
                # an operator may begin the next line
                k = self.i
                while self.tokens[k].kind == "eol" and self.tokens[k].value != ";":
                    k += 1
                n = self.tokens[k]
                if n.kind == "op" and n.value in BINARY and n.value not in ("+", "-", "//", "..") or n.kind == "word" and n.value in ("and", "or", "in", "when"):
                    prec = BINARY[n.value][0]
                    if prec < least:
                        return left
                    self.i = k
                    t = n
                else:
                    return left
            op = t.value if t.kind in ("op", "word") else None
            if t.kind == "word" and op == "not" and self.ahead().kind == "word" and self.ahead().value == "in":
                op = "not in"
            if op not in BINARY or t.kind == "word" and op not in ("and", "or", "in", "when", "not in"):
                return left
            prec, right_assoc = BINARY[op]
            if prec < least:
                return left
            self.next()
            if op == "not in":
                self.next()
            self.skip_eol()
            if op == "when" and self.now.kind == "key":
                right = self.bare_args()[0]
            elif op == "|" and self.now.kind == "key":  # %{map | key: value}
                right = self.pair()
            else:
                right = self.expr(prec if right_assoc else prec + 1)
            if op == "not in":
                inner = self.node("call", left, name="in", args=[left, right])
                left = self.node("call", left, name="not", args=[inner])
            elif op == "//" and left.kind == "call" and left.name == "..":
                left = self.node("call", left, name="..//", args=[*left.args, right])
            else:
                left = self.node("call", left, name=op, args=[left, right], flags="op")
            left.line, left.col = (t.line, t.col) if op != "not in" else (left.line, left.col)

    def unary(self, least: int = 0) -> Node:
        t = self.now
        if t.kind == "op" and t.value in UNARY:
            self.next()
            self.skip_eol()
            if t.value == "&" and self.now.kind == "int" and not self.now.spaced:
                arg = self.primary()
                return self.postfix(self.node("call", t, name="&", args=[arg]))
            if t.value == "&" and self.now.kind in ("op", "word") and self.now.value in BINARY and self.ahead().kind == "op" and self.ahead().value == "/":
                name, slash = self.next(), self.next()
                arity = self.primary()
                named = Node("var", name.line, name.col, name.start, name.end, name=name.value)
                return self.node("call", t, name="&", args=[self.node("call", name, name=slash.value, args=[named, arity], flags="op")])
            if t.value == "@":
                return self.postfix(self.attribute(t))
            arg = self.expr(UNARY[t.value])
            return self.node("call", t, name=t.value, args=[arg])
        if t.kind == "op" and t.value in ("..", "..."):
            self.next()
            return self.node("call", t, name=t.value, args=[])
        if t.kind == "word" and t.value == "not":
            self.next()
            arg = self.expr(UNARY["not"])
            return self.node("call", t, name="not", args=[arg])
        return self.postfix(self.primary())

    def attribute(self, at: Token) -> Node:
        name = self.next()
        if name.kind not in ("ident", "word"):
            raise self.fail(name)
        if self.can_start_argument(name):
            args = self.bare_args()
            inner = self.node("call", name, name=name.value, args=args)
        elif self.is_op("(") and not self.now.spaced:
            inner = self.node("call", name, name=name.value, args=self.paren_args())
        else:
            inner = self.node("var", name, name=name.value)
        return self.node("call", at, name="@", args=[inner])

    def postfix(self, left: Node) -> Node:
        while True:
            t = self.now
            if t.kind == "op" and t.value == ".":
                n = self.ahead()
                if n.kind == "op" and n.value == "(":
                    self.next()
                    args = self.paren_args()
                    left = self.node("call", left, args=args, target=left, flags="anon")
                    left = self.with_do(left)
                elif n.kind == "alias":
                    self.next()
                    self.next()
                    if left.kind == "alias":
                        left = self.node("alias", left, name=f"{left.name}.{n.value}")
                    else:
                        left = self.node("alias", left, name=n.value, target=left)
                elif n.kind in ("ident", "word", "str") or n.kind == "op" and n.value not in "()[]{},.":
                    self.next()
                    self.next()
                    name = n.value[0] if n.kind == "str" else n.value
                    if self.is_op("(") and not self.now.spaced:
                        args = self.paren_args()
                        left = self.node("call", left, name=name, args=args, target=left)
                        left.line = n.line
                    elif self.can_start_argument(n):
                        args = self.bare_args()
                        left = self.node("call", left, name=name, args=args, target=left)
                        left.line = n.line
                    else:
                        left = self.node("call", left, name=name, target=left, flags="noparens")
                        left.line = n.line
                    left = self.with_do(left)
                elif n.kind == "op" and n.value == "{":
                    self.next()
                    self.next()
                    args = self.items("}")
                    left = self.node("call", left, name="{}", args=args, target=left)
                else:
                    raise self.fail(n)
            elif t.kind == "op" and t.value == "[" and not t.spaced and left.kind not in ("int", "float"):
                self.next()
                args = self.items("]")
                access = self.node("alias", left, name="Access")
                left = self.node("call", left, name="get", args=[left, *args], target=access, flags="access")
            elif t.kind == "op" and t.value == "(" and not t.spaced and left.kind == "call" and left.flags != "op":
                args = self.paren_args()
                left = self.node("call", left, args=args, target=left, flags="anon")
            else:
                return left

    def can_start_argument(self, name: Token) -> bool:
        """Whether the token after an identifier begins an argument without parentheses."""
        t = self.now
        if not t.spaced:
            return False
        if t.kind == "word" and t.value == "not":
            return not (self.ahead().kind == "word" and self.ahead().value == "in")
        if t.kind in _STARTS or t.kind == "word" and t.value in _START_WORDS:
            return True
        if t.kind != "op":
            return False
        tight = not self.ahead().spaced and self.ahead().kind != "eol"
        if t.value in ("[", "{", "(", "%", "<<", "!", "^", "@", "~~~"):
            return True
        if t.value in ("&",):
            return True
        if t.value in ("+", "-") and tight:
            return True
        return False

    def bare_args(self) -> list[Node]:
        args = []
        keys: list[Node] = []
        self.no_do += 1  # a `do` after the arguments belongs to the call without parentheses
        while True:
            if self.now.kind == "key":
                keys.append(self.pair())
            elif keys:
                raise self.fail()
            else:
                args.append(self.expr())
            if self.is_op(","):
                self.next()
                self.skip_eol()
                continue
            break
        self.no_do -= 1
        if keys:
            args.append(self.keywords(keys))
        return args

    def keywords(self, pairs: list[Node]) -> Node:
        out = self.node("list", pairs[0], args=pairs, flags="kw")
        return out

    def pair(self) -> Node:
        t = self.next()
        parts = t.value
        if isinstance(parts, list) and len(parts) == 1 and isinstance(parts[0], str):
            parts = parts[0]
        key = Node("atom", t.line, t.col, t.start, t.end, value=parts if isinstance(parts, str) else "")
        self.skip_eol()
        value = self.expr(3)
        return self.node("tuple", t, args=[key, value], flags="pair")

    def items(self, close: str) -> list[Node]:
        """Comma-separated elements up to ``close``, which is consumed; trailing keywords become a keyword list."""
        out: list[Node] = []
        keys: list[Node] = []
        held, self.no_do = self.no_do, 0
        self.skip_eol()
        while not self.is_op(close):
            if self.now.kind == "key":
                keys.append(self.pair())
            elif keys and close not in ("}",):
                raise self.fail()
            else:
                out.append(self.expr())
            self.skip_eol()
            if self.is_op(","):
                self.next()
                self.skip_eol()
            elif not self.is_op(close):
                raise self.fail()
        self.next()
        self.no_do = held
        if keys and close in ("]",):
            return out + keys
        if keys and close == "}":
            return out + keys
        return [*out, self.keywords(keys)] if keys else out

    def paren_args(self) -> list[Node]:
        self.expect("(")
        return self.items(")")

    def with_do(self, call: Node) -> Node:
        if self.no_do or not self.is_word("do"):
            return call
        block = self.do_block()
        call.args.append(block)
        call.flags = (call.flags + " do").replace("noparens", "").strip()
        call.end = self.tokens[self.i - 1].end
        return call

    def do_block(self) -> Node:
        t = self.next()
        pairs = []
        word, at = "do", t
        held, self.no_do = self.no_do, 0
        while True:
            first = self.now
            body = self.clauses_or_block(lambda: self.is_word("end", *BLOCK_WORDS), first)
            key = Node("atom", at.line, at.col, at.start, at.end, value=word)
            pairs.append(self.node("tuple", at, args=[key, body], flags="pair"))
            if self.now.kind == "eof":
                raise ParseError(t.line, "end", "missing terminator")
            at = self.next()
            if at.value == "end":
                break
            word = at.value
        self.no_do = held
        return self.node("list", t, args=pairs, flags="do")

    def clauses_or_block(self, done, first: Token) -> Node:
        """The statements of a block, or its `pattern -> body` clauses as a block of clauses."""
        self.skip_eol()
        if done():
            return self.node("block", first, args=[])
        if not self.has_arrow(done):
            out = self.statements(lambda: done() or self.now.kind == "eof")
            return self.blocked(out, first)
        clauses = []
        while not done():
            if self.now.kind == "eof":
                break
            clauses.append(self.clause(done))
            self.skip_eol()
        return self.node("block", first, args=clauses, flags="clauses")

    def has_arrow(self, done) -> bool:
        """Looks for an arrow at this level before the block's first statement ends."""
        depth, k = 0, self.i
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "eof":
                return False
            if t.kind == "op" and t.value in ("(", "[", "{", "<<"):
                depth += 1
            elif t.kind == "op" and t.value in (")", "]", "}", ">>"):
                depth -= 1
                if depth < 0:
                    return False
            elif t.kind == "word" and t.value in ("do", "fn"):
                depth += 1
            elif t.kind == "word" and t.value == "end":
                if not depth:
                    return False
                depth -= 1
            elif not depth and t.kind == "op" and t.value == "->":
                return True
            elif not depth and t.kind == "eol":
                n = self.tokens[k + 1]
                p = self.tokens[k - 1]
                if not (p.kind == "op" and (p.value in BINARY or p.value == ",") or n.kind == "op" and n.value in BINARY and n.value not in "+-" or n.kind == "word" and n.value in ("when", "and", "or", "in") or p.kind == "word" and p.value in ("when", "and", "or", "in", "not")):
                    return False
            k += 1
        return False

    def clause(self, done) -> Node:
        t = self.now
        args: list[Node] = []
        keys: list[Node] = []
        if not self.is_op("->"):
            if self.is_op("(") and self.wraps_args():
                self.next()
                args = self.items(")")
                if self.is_word("when"):
                    self.next()
                    guard = self.expr(3)
                    args = [self.node("call", t, name="when", args=[*args, guard], flags="op")]
            else:
                while True:
                    if self.now.kind == "key":
                        keys.append(self.pair())
                    else:
                        args.append(self.expr(3))
                    if self.is_op(","):
                        self.next()
                        self.skip_eol()
                        continue
                    break
                if keys:
                    args.append(self.keywords(keys))
                self.over_eol_to_when()
                if self.is_word("when"):
                    self.next()
                    self.skip_eol()
                    guard = self.expr(2)
                    args = [self.node("call", t, name="when", args=[*args, guard], flags="op")]
        arrow = self.expect("->")
        first = self.now
        self.skip_eol()
        out = []
        while not done() and self.now.kind != "eof":
            if out and self.has_arrow(done):
                break
            out.append(self.expr())
            if done() or self.now.kind == "eof":
                break
            if self.now.kind != "eol":
                raise self.fail()
            self.skip_eol()
        body = self.blocked(out, first)
        clause = self.node("clause", t, args=args, body=body)
        clause.line = arrow.line if not args else clause.line
        return clause

    def over_eol_to_when(self) -> None:
        k = self.i
        while self.tokens[k].kind == "eol":
            k += 1
        if self.tokens[k].kind == "word" and self.tokens[k].value == "when":
            self.i = k

    def wraps_args(self) -> bool:
        """Whether the parenthesis here encloses all arguments of a clause."""
        depth, k = 0, self.i
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "op" and t.value in ("(", "[", "{", "<<"):
                depth += 1
            elif t.kind == "op" and t.value in (")", "]", "}", ">>"):
                depth -= 1
                if not depth:
                    n = self.tokens[k + 1]
                    return n.kind == "op" and n.value == "->" or n.kind == "word" and n.value == "when"
            elif t.kind == "eof":
                return False
            k += 1
        return False

    # -- primary

    def text_node(self, t: Token, kind: str, parts: list, flags: str = "") -> Node:
        if all(isinstance(p, str) for p in parts):
            return self.node(kind, t, value="".join(parts), flags=flags)
        args = []
        for p in parts:
            if isinstance(p, str):
                args.append(Node("str", t.line, t.col, t.start, t.end, value=p))
            else:
                args.append(Parser(p, self.text).program())
        return self.node("interp", t, args=args, flags=flags or kind)

    def primary(self) -> Node:
        t = self.next()
        kind = t.kind
        if kind in ("int", "float"):
            return self.node(kind, t, value=t.value)
        if kind in ("str", "charlist", "str_heredoc", "charlist_heredoc"):
            return self.text_node(t, kind.split("_")[0], t.value, "heredoc" if "_" in kind else "")
        if kind == "sigil":
            name, parts, mods = t.value
            inner = self.text_node(t, "str", parts)
            return self.node("sigil", t, name=name, value=mods, args=[inner])
        if kind == "atom":
            return self.node("atom", t, value=t.value) if isinstance(t.value, str) else self.text_node(t, "atom", t.value)
        if kind == "alias":
            return self.node("alias", t, name=t.value)
        if kind == "word":
            if t.value in ("true", "false", "nil"):
                return self.node("atom", t, value=t.value)
            if t.value == "fn":
                return self.anonymous(t)
            raise self.fail(t)
        if kind == "ident":
            return self.identifier(t)
        if kind == "op":
            if t.value == "(":
                return self.parenthesised(t)
            if t.value == "[":
                return self.node("list", t, args=self.items("]"))
            if t.value == "{":
                return self.node("tuple", t, args=self.items("}"))
            if t.value == "<<":
                return self.node("bits", t, args=self.items(">>"))
            if t.value == "%":
                return self.map(t)
        raise self.fail(t)

    def parenthesised(self, t: Token) -> Node:
        held, self.no_do = self.no_do, 0
        self.skip_eol()
        first = self.now
        closed = lambda: self.is_op(")")
        if self.has_arrow(closed):
            body = self.clauses_or_block(closed, first)
        else:
            out = self.statements(lambda: closed() or self.now.kind == "eof")
            body = self.blocked(out, first) if out else self.node("block", t, args=[])
        self.expect(")")
        self.no_do = held
        # the span of a parenthesised expression holds its parentheses
        if len(body.args) != 1 or body.kind != "block":
            body.start, body.end = t.start, self.tokens[self.i - 1].end
        if body.flags == "op":
            body.flags = "op parens"
        return body

    def identifier(self, t: Token) -> Node:
        if self.is_op("(") and not self.now.spaced:
            call = self.node("call", t, name=t.value, args=self.paren_args())
            call.end = self.tokens[self.i - 1].end
            return self.with_do(call)
        if self.can_start_argument(t):
            args = self.bare_args()
            return self.with_do(self.node("call", t, name=t.value, args=args, flags="bare"))
        if not self.no_do and self.is_word("do") and t.value not in ("do",) and self.do_follows_call(t):
            return self.with_do(self.node("call", t, name=t.value, args=[]))
        return self.node("var", t, name=t.value)

    def do_follows_call(self, t: Token) -> bool:
        """`setup do` opens a block of the identifier itself if nothing before it on the statement is a call."""
        p = self.tokens[self.i - 2] if self.i >= 2 else None
        return p is None or p.kind == "eol" or p.kind == "op" and p.value in ("=", "->", "(", "|>", "<-") or p.kind == "word" and p.value in ("do", "else", "->")

    def anonymous(self, t: Token) -> Node:
        held, self.no_do = self.no_do, 0
        clauses = []
        ended = lambda: self.is_word("end")
        self.skip_eol()
        while not ended():
            if self.now.kind == "eof":
                raise ParseError(t.line, "end", "missing terminator")
            clauses.append(self.clause(ended))
            self.skip_eol()
        self.next()
        self.no_do = held
        return self.node("fn", t, args=clauses)

    def map(self, t: Token) -> Node:
        if self.is_op("{") and not self.now.spaced:
            self.next()
            return self.node("map", t, args=self.items("}"))
        held = self.no_do
        name = self.postfix(self.primary()) if not self.is_op("^", "@") else self.unary()
        self.no_do = held
        self.expect("{")
        inner = self.node("map", t, args=self.items("}"))
        return self.node("struct", t, args=[name, inner])


def parse(text: str) -> Node:
    """The tree of a source text; raises ParseError."""
    text = text or ""
    return Parser(Lexer(text).run(), text).program()
