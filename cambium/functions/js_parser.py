"""A recursive-descent parser of JavaScript modules (ES2020 and later, no JSX) into concrete syntax trees.

Node kinds are those that the analysis rules name; punctuation and keywords are unnamed children. Offsets are code points
while parsing; `Tree.byte` maps them to UTF-8 bytes. A text that does not parse raises ParseError with a 1-based position.
"""

from __future__ import annotations

import contextlib
import gc
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Statements or expressions within one another, and the interpreter frames that they need.
DEEPEST, FRAMES = 1500, 60_000


@contextlib.contextmanager
def steady() -> Iterator[None]:
    """Trees are many small objects that stay: the collector would look through them again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class ParseError(ValueError):
    def __init__(self, text: str, at: int, what: str = "unexpected token"):
        at = min(at, len(text))
        self.line = text.count("\n", 0, at) + 1
        self.column = at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{what} at {self.line}:{self.column}")


@dataclass(slots=True, eq=False)
class Node:
    kind: str
    start: int
    end: int
    named: bool = True
    children: list[Node] = field(default_factory=list)
    fields: dict[str, Node] = field(default_factory=dict)
    parent: Node | None = field(default=None, repr=False)
    ordinal: int = 0  # place among the parent's children

    def all(self, kind: str) -> list[Node]:
        return [c for c in self.children if c.kind == kind]

    def walk(self):
        """Nodes in pre-order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))


@dataclass
class Tree:
    text: str
    root: Node
    comments: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self._attach()
        for n in self.root.walk():
            for k, c in enumerate(n.children):
                c.parent, c.ordinal = n, k
        self._bytes = None if self.text.isascii() else self._prefix()
        self._lines = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def _attach(self) -> None:
        """Makes each comment a child of the innermost node around it. Comments ascend, so one walk places them all."""
        left, k = self.comments, 0
        stack = [(self.root, 0)]
        out: list[Node] = []
        if not left:
            return
        # In pre-order: before a child begins, the comments that end before it belong to its parent.
        kids: dict[int, list[Node]] = {}
        while stack:
            n, i = stack.pop()
            own = kids.setdefault(id(n), [])
            last = n.children[i].start if i < len(n.children) else n.end
            while k < len(left) and left[k][1] <= last:
                own.append(Node("comment", *left[k]))
                k += 1
            if i < len(n.children):
                c = n.children[i]
                own.append(c)
                stack.append((n, i + 1))
                if c.children:
                    stack.append((c, 0))
                else:
                    while k < len(left) and left[k][0] < c.end:  # inside a leaf there is none
                        k += 1
            else:
                out.append(n)
        for n in out:
            n.children = kids[id(n)]

    def _prefix(self) -> np.ndarray:
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        return np.concatenate([[0], np.cumsum(widths)])

    def byte(self, at: int) -> int:
        return at if self._bytes is None else int(self._bytes[at])

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at)

    def column(self, at: int) -> int:
        return at - self._lines[bisect_right(self._lines, at) - 1]

    def of(self, node: Node) -> str:
        return self.text[node.start : node.end]


@dataclass(slots=True)
class Token:
    kind: str  # name, number, string, template, regex, private, punct, end
    text: str
    start: int
    end: int
    newline: bool  # a line break stands before it


_SPACE = re.compile("(?:[\\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\\*.*?\\*/|<!--[^\n]*)+", re.S)
_COMMENT = re.compile("//[^\n\r\u2028\u2029]*|/\\*.*?\\*/|<!--[^\n]*", re.S)
_BREAK = re.compile("[\n\r\u2028\u2029]")
_NAME = re.compile(r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_PUNCT = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]")

_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
_ATOMS = {"this": "this", "super": "super", "null": "null", "true": "true", "false": "false", "undefined": "undefined"}
#: After these a slash divides; names before a value, after which it does not.
_OPERANDS = {"name", ")", "]", "}", "`"}
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await"}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)


class Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.comments: dict[int, int] = {}
        self.arrows: dict[int, bool] = {}  # place of each "(" met so far: does an arrow follow its end?
        self.ahead: Token | None = None
        self.depth = 0
        self.last_end = 0

    # Tokens

    def fail(self, at: int | None = None, what: str = "unexpected token"):
        raise ParseError(self.text, self.peek().start if at is None else at, what)

    def scan(self, at: int) -> Token:
        text, newline = self.text, False
        if m := _SPACE.match(text, at):
            space = m[0]
            newline = _BREAK.search(space) is not None
            if "/" in space or "<" in space:
                for c in _COMMENT.finditer(space):
                    self.comments[at + c.start()] = at + c.end()
            at = m.end()
        if text.startswith("/*", at):
            self.fail(at, "comment does not end")
        if at >= len(text):
            return Token("end", "", len(text), len(text), newline)
        c = text[at]
        if m := _NAME.match(text, at):
            kind = "name"
        elif c == "#" and (m := _NAME.match(text, at + 1)):
            return Token("private", text[at : m.end()], at, m.end(), newline)
        elif (c.isdigit() or c == "." and text[at + 1 : at + 2].isdigit()) and (m := _NUMBER.match(text, at)):
            kind = "number"
        elif c in "\"'":
            m, kind = _STRING.match(text, at), "string"
        elif c == "`":
            return Token("template", "`", at, at + 1, newline)
        else:
            m, kind = _PUNCT.match(text, at), "punct"
        if not m:
            self.fail(at)
        return Token(kind, m[0], at, m.end(), newline)

    def peek(self) -> Token:
        if self.ahead is None:
            self.ahead = self.scan(self.at)
        return self.ahead

    def second(self) -> Token:
        return self.scan(self.peek().end)

    def take(self) -> Token:
        t = self.peek()
        self.at, self.ahead, self.last_end = t.end, None, t.end
        return t

    def is_(self, *texts: str) -> bool:
        t = self.peek()
        return t.kind in ("punct", "name") and t.text in texts

    def leaf(self, t: Token, kind: str | None = None, named: bool = False) -> Node:
        return Node(kind or t.text, t.start, t.end, named)

    def expect(self, text: str) -> Node:
        if not self.is_(text):
            self.fail()
        return self.leaf(self.take())

    def maybe(self, text: str) -> Node | None:
        return self.leaf(self.take()) if self.is_(text) else None

    def node(self, kind: str, children: list[Node | None], **fields: Node | None) -> Node:
        kids = [c for c in children if c is not None]
        return Node(kind, kids[0].start if kids else self.at, kids[-1].end if kids else self.at, True, kids, {k: v for k, v in fields.items() if v is not None})

    def name(self, kind: str = "identifier") -> Node:
        t = self.peek()
        if t.kind != "name" or t.text in _WORDS:
            self.fail()
        return self.leaf(self.take(), kind, True)

    def semicolon(self) -> Node | None:
        t = self.peek()
        if self.is_(";"):
            return self.leaf(self.take())
        if t.kind == "end" or t.newline or self.is_("}"):
            return None
        self.fail()

    # Statements

    def program(self) -> Node:
        kids = []
        if self.text.startswith("#!"):
            end = (self.text.find("\n") + len(self.text) + 1) % (len(self.text) + 1) or len(self.text)
            kids.append(Node("hash_bang_line", 0, end))
            self.at = end
        while self.peek().kind != "end":
            kids.append(self.statement())
        return Node("program", 0, len(self.text), True, kids)

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            self.fail(what="nested too deeply")
        out = self._statement()
        self.depth -= 1
        return out

    def _statement(self) -> Node:
        t = self.peek()
        if t.kind == "punct" and t.text == "{":
            return self.block()
        if t.kind == "punct" and t.text == ";":
            return self.node("empty_statement", [self.leaf(self.take())])
        if t.kind == "punct" and t.text == "@":
            return self.class_("class_declaration", True)
        if t.kind == "name":
            way = getattr(self, f"on_{t.text}", None) if t.text in self.STARTS else None
            if way:
                return way()
            if t.text == "async" and (s := self.second()).text == "function" and not s.newline:
                return self.function("function_declaration", True)
            if t.text == "let" and ((s := self.second()).kind == "name" and s.text not in ("in", "instanceof") or s.text in ("[", "{")):
                return self.declaration("lexical_declaration")
            if t.text not in _WORDS and self.second().text == ":":
                label = self.leaf(self.take(), "statement_identifier", True)
                return self.node("labeled_statement", [label, self.leaf(self.take()), body := self.statement()], label=label, body=body)
            if t.text == "import" and self.second().text not in ("(", "."):
                return self.import_()
        e = self.expression()
        return self.node("expression_statement", [e, self.semicolon()])

    STARTS = {"var", "const", "function", "class", "if", "for", "while", "do", "return", "break", "continue", "throw", "try", "switch", "with", "debugger", "export"}

    def block(self, kind: str = "statement_block") -> Node:
        kids = [self.expect("{")]
        while not self.is_("}"):
            if self.peek().kind == "end":
                self.fail(what="block does not end")
            kids.append(self.statement())
        kids.append(self.expect("}"))
        return self.node(kind, kids)

    def on_var(self) -> Node:
        return self.declaration("variable_declaration")

    def on_const(self) -> Node:
        return self.declaration("lexical_declaration")

    def declaration(self, kind: str, in_for: bool = False) -> Node:
        kids = [self.leaf(self.take())]
        while True:
            target = self.pattern()
            own, value = [target], None
            if self.is_("="):
                own.append(self.leaf(self.take()))
                value = self.assignment(not in_for)
                own.append(value)
            kids.append(self.node("variable_declarator", own, name=target, value=value))
            if not self.is_(","):
                break
            kids.append(self.leaf(self.take()))
        if not in_for:
            kids.append(self.semicolon())
        return self.node(kind, kids)

    def on_function(self) -> Node:
        return self.function("function_declaration", True)

    def function(self, kind: str, needs_name: bool) -> Node:
        kids = [self.maybe("async"), self.expect("function")]
        if star := self.maybe("*"):
            kids.append(star)
            kind = "generator_function_declaration" if kind == "function_declaration" else "generator_function"
        name = None
        if self.peek().kind == "name" and not self.is_("("):
            name = self.name()
        elif needs_name:
            self.fail()
        params, body = self.parameters(), None
        body = self.block()
        return self.node(kind, [*kids, name, params, body], name=name, parameters=params, body=body)

    def parameters(self) -> Node:
        kids = [self.expect("(")]
        while not self.is_(")"):
            kids.append(self.parameter())
            if not self.is_(")"):
                kids.append(self.expect(","))
        kids.append(self.expect(")"))
        return self.node("formal_parameters", kids)

    def parameter(self) -> Node:
        if self.is_("..."):
            return self.node("rest_pattern", [self.leaf(self.take()), self.pattern()])
        p = self.pattern()
        if self.is_("="):
            eq = self.leaf(self.take())
            right = self.assignment()
            return self.node("assignment_pattern", [p, eq, right], left=p, right=right)
        return p

    def pattern(self) -> Node:
        if self.is_("{", "["):
            return self.as_pattern(self.primary())
        return self.name()

    def on_class(self) -> Node:
        return self.class_("class_declaration", True)

    def class_(self, kind: str, needs_name: bool) -> Node:
        kids: list[Node | None] = []
        while self.is_("@"):
            kids.append(self.decorator())
        kids.append(self.expect("class"))
        name = None
        if self.peek().kind == "name" and not self.is_("extends"):
            name = self.name()
        elif needs_name:
            self.fail()
        kids.append(name)
        if self.is_("extends"):
            word = self.leaf(self.take())
            kids.append(self.node("class_heritage", [word, self.postfix()]))
        body = self.class_body()
        return self.node(kind, [*kids, body], name=name, body=body)

    def decorator(self) -> Node:
        return self.node("decorator", [self.leaf(self.take()), self.postfix()])

    def class_body(self) -> Node:
        kids = [self.expect("{")]
        while not self.is_("}"):
            if self.is_(";"):
                kids.append(self.leaf(self.take()))
            elif self.is_("static") and self.second().text == "{":
                word = self.leaf(self.take())
                body = self.block()
                kids.append(self.node("class_static_block", [word, body], body=body))
            else:
                kids.append(self.member())
        kids.append(self.expect("}"))
        return self.node("class_body", kids)

    def member(self) -> Node:
        kids: list[Node | None] = []
        while self.is_("@"):
            kids.append(self.decorator())
        ends = ("(", "=", ";", "}", ",", ":")
        for word in ("static", "async", "get", "set", "accessor"):
            if self.is_(word) and self.second().text not in ends and not (word == "async" and self.second().newline):
                kids.append(self.leaf(self.take()))
        kids.append(self.maybe("*"))
        key = self.property_name()
        if self.is_("("):
            params = self.parameters()
            body = self.block()
            return self.node("method_definition", [*kids, key, params, body], name=key, parameters=params, body=body)
        value, eq = None, None
        if self.is_("="):
            eq = self.leaf(self.take())
            value = self.assignment()
        out = self.node("field_definition", [*kids, key, eq, value], property=key, value=value)
        if not self.is_("}"):
            end = self.semicolon()
            del end
        return out

    def property_name(self) -> Node:
        t = self.peek()
        if t.kind == "name":
            return self.leaf(self.take(), "property_identifier", True)
        if t.kind == "private":
            return self.leaf(self.take(), "private_property_identifier", True)
        if t.kind == "string":
            return self.string()
        if t.kind == "number":
            return self.leaf(self.take(), "number", True)
        if self.is_("["):
            return self.node("computed_property_name", [self.leaf(self.take()), self.assignment(), self.expect("]")])
        self.fail()

    def grouped(self) -> Node:
        return self.node("parenthesized_expression", [self.expect("("), self.expression(), self.expect(")")])

    def on_if(self) -> Node:
        word, test, then = self.leaf(self.take()), self.grouped(), self.statement()
        otherwise = None
        if self.is_("else"):
            otherwise = self.node("else_clause", [self.leaf(self.take()), self.statement()])
        return self.node("if_statement", [word, test, then, otherwise], condition=test, consequence=then, alternative=otherwise)

    def on_while(self) -> Node:
        word, test = self.leaf(self.take()), self.grouped()
        return self.node("while_statement", [word, test, body := self.statement()], condition=test, body=body)

    def on_do(self) -> Node:
        word, body = self.leaf(self.take()), self.statement()
        return self.node("do_statement", [word, body, self.expect("while"), test := self.grouped(), self.maybe(";")], body=body, condition=test)

    def on_with(self) -> Node:
        word, obj = self.leaf(self.take()), self.grouped()
        return self.node("with_statement", [word, obj, body := self.statement()], object=obj, body=body)

    def on_for(self) -> Node:
        kids = [self.leaf(self.take()), self.maybe("await"), self.expect("(")]
        start: Node | None = None
        if self.is_("var", "const") or self.is_("let") and self.second().text not in ("in", "=", ";", "."):
            kind = "variable_declaration" if self.is_("var") else "lexical_declaration"
            word = self.leaf(self.take())
            target = self.pattern()
            if self.is_("of", "in"):
                return self.for_in([*kids, word, target], target)
            own, value = [target], None
            if self.is_("="):
                own.append(self.leaf(self.take()))
                value = self.assignment(False)
                own.append(value)
            decls = [word, self.node("variable_declarator", own, name=target, value=value)]
            while self.is_(","):
                decls.append(self.leaf(self.take()))
                t2 = self.pattern()
                own, value = [t2], None
                if self.is_("="):
                    own.append(self.leaf(self.take()))
                    value = self.assignment(False)
                    own.append(value)
                decls.append(self.node("variable_declarator", own, name=t2, value=value))
            decls.append(self.expect(";"))
            start = self.node(kind, decls)
        elif self.is_(";"):
            start = self.node("empty_statement", [self.leaf(self.take())])
        else:
            e = self.expression(False)
            if self.is_("of", "in"):
                e = self.as_pattern(e)
                return self.for_in([*kids, e], e)
            start = self.node("expression_statement", [e, self.expect(";")])
        test = self.node("empty_statement", [self.leaf(self.take())]) if self.is_(";") else self.node("expression_statement", [self.expression(), self.expect(";")])
        step = None if self.is_(")") else self.expression()
        return self.node("for_statement", [*kids, start, test, step, self.expect(")"), body := self.statement()], initializer=start, condition=test, increment=step, body=body)

    def for_in(self, kids: list[Node | None], left: Node) -> Node:
        word = self.leaf(self.take())
        right = self.assignment() if word.kind == "of" else self.expression()
        return self.node("for_in_statement", [*kids, word, right, self.expect(")"), body := self.statement()], left=left, right=right, body=body)

    def on_return(self) -> Node:
        return self._jump("return_statement", True)

    def on_throw(self) -> Node:
        return self._jump("throw_statement", True)

    def on_break(self) -> Node:
        return self._jump("break_statement", False)

    def on_continue(self) -> Node:
        return self._jump("continue_statement", False)

    def on_debugger(self) -> Node:
        return self._jump("debugger_statement", False)

    def _jump(self, kind: str, valued: bool) -> Node:
        kids: list[Node | None] = [self.leaf(self.take())]
        t = self.peek()
        if not (t.newline or t.kind == "end" or self.is_(";", "}")):
            kids.append(self.expression() if valued else self.leaf(self.take(), "statement_identifier", True))
        return self.node(kind, [*kids, self.semicolon()])

    def on_try(self) -> Node:
        word, body = self.leaf(self.take()), self.block()
        handler = last = None
        if self.is_("catch"):
            own, param = [self.leaf(self.take())], None
            if self.is_("("):
                own += [self.leaf(self.take()), param := self.pattern(), self.expect(")")]
            own.append(inner := self.block())
            handler = self.node("catch_clause", own, parameter=param, body=inner)
        if self.is_("finally"):
            last = self.node("finally_clause", [self.leaf(self.take()), self.block()])
        if handler is None and last is None:
            self.fail()
        return self.node("try_statement", [word, body, handler, last], body=body, handler=handler, finalizer=last)

    def on_switch(self) -> Node:
        word, value = self.leaf(self.take()), self.grouped()
        kids = [self.expect("{")]
        while not self.is_("}"):
            if self.is_("case"):
                own: list[Node | None] = [self.leaf(self.take()), self.expression(), self.expect(":")]
                kind = "switch_case"
            else:
                own, kind = [self.expect("default"), self.expect(":")], "switch_default"
            while not self.is_("case", "default", "}"):
                own.append(self.statement())
            kids.append(self.node(kind, own))
        kids.append(self.expect("}"))
        body = self.node("switch_body", kids)
        return self.node("switch_statement", [word, value, body], value=value, body=body)

    def import_(self) -> Node:
        kids: list[Node | None] = [self.leaf(self.take())]
        if self.peek().kind != "string":
            own: list[Node | None] = []
            while True:
                if self.is_("*"):
                    own.append(self.node("namespace_import", [self.leaf(self.take()), self.expect("as"), self.name()]))
                elif self.is_("{"):
                    own.append(self.specifiers("named_imports", "import_specifier"))
                else:
                    own.append(self.name())
                if not self.is_(","):
                    break
                own.append(self.leaf(self.take()))
            kids += [self.node("import_clause", own), self.expect("from")]
        source = self.string()
        kids.append(source)
        if self.is_("with", "assert") and self.second().text == "{":
            kids.append(self.node("import_attribute", [self.leaf(self.take()), self.primary()]))
        return self.node("import_statement", [*kids, self.semicolon()], source=source)

    def specifiers(self, kind: str, each: str) -> Node:
        kids = [self.expect("{")]
        while not self.is_("}"):
            one = lambda: self.string() if self.peek().kind == "string" else self.leaf(self.take(), "identifier", True)
            name, alias, word = one(), None, None
            if self.is_("as"):
                word, alias = self.leaf(self.take()), one()
            kids.append(self.node(each, [name, word, alias], name=name, alias=alias))
            if not self.is_("}"):
                kids.append(self.expect(","))
        kids.append(self.expect("}"))
        return self.node(kind, kids)

    def on_export(self) -> Node:
        kids: list[Node | None] = [self.leaf(self.take())]
        if self.is_("*"):
            star = self.leaf(self.take())
            if self.is_("as"):
                star = self.node("namespace_export", [star, self.leaf(self.take()), self.leaf(self.take(), "identifier", True)])
            kids += [star, self.expect("from"), source := self.string()]
            return self.node("export_statement", [*kids, self.semicolon()], source=source)
        if self.is_("{"):
            clause, source = self.specifiers("export_clause", "export_specifier"), None
            kids.append(clause)
            if self.is_("from"):
                kids += [self.leaf(self.take()), source := self.string()]
            return self.node("export_statement", [*kids, self.semicolon()], clause=clause, source=source)
        if self.is_("default"):
            kids.append(self.leaf(self.take()))
            t = self.peek()
            if self.is_("function") or t.text == "async" and self.second().text == "function":
                f = self.function("function_declaration", False)
                if "name" not in f.fields:
                    f.kind = f.kind.replace("_declaration", "_expression") if f.kind == "function_declaration" else "generator_function"
                return self.node("export_statement", [*kids, f], **({"declaration": f} if "name" in f.fields else {"value": f}))
            if self.is_("class", "@"):
                c = self.class_("class_declaration", False)
                if "name" not in c.fields:
                    c.kind = "class_expression"
                return self.node("export_statement", [*kids, c], **({"declaration": c} if "name" in c.fields else {"value": c}))
            value = self.assignment()
            return self.node("export_statement", [*kids, value, self.semicolon()], value=value)
        inner = self.statement()
        if inner.kind not in ("variable_declaration", "lexical_declaration", "function_declaration", "generator_function_declaration", "class_declaration"):
            self.fail(inner.start)
        return self.node("export_statement", [*kids, inner], declaration=inner)

    # Expressions

    def expression(self, in_ok: bool = True) -> Node:
        left = self.assignment(in_ok)
        while self.is_(","):
            comma = self.leaf(self.take())
            right = self.assignment(in_ok)
            left = self.node("sequence_expression", [left, comma, right])
        return left

    def arrow_ahead(self) -> bool:
        """Does ( ... ) => start here? Every "(" inside is answered at the same time, so no text is looked through twice."""
        t = self.second() if self.is_("async") else self.peek()
        if t.start not in self.arrows:
            try:
                self._look(t.start)
            except ParseError:
                pass
        return self.arrows.get(t.start, False)

    def _look(self, at: int) -> None:
        """Matches brackets from the "(" at `at` to its end and notes which are followed by an arrow. A slash starts a
        regular expression where no operand stands before it."""
        text, before = self.text, ""
        stack: list[tuple[str, int]] = []
        while True:
            if stack and stack[-1][0] == "`":
                m = _TEMPLATE.match(text, at)
                at = m.end()
                if text.startswith("`", at):
                    stack.pop()
                    before, at = "`", at + 1
                elif text.startswith("${", at):
                    stack.append(("${", at))
                    before, at = "{", at + 2
                else:
                    return
                continue
            t = self.scan(at)
            if t.kind == "end":
                return
            if t.kind == "template":
                stack.append(("`", t.start))
                at = t.end
                continue
            if t.kind == "punct" and t.text in ("/", "/=") and before not in _OPERANDS and (m := _REGEX.match(text, t.start)):
                before, at = "name", m.end()
                continue
            at = t.end
            before = t.text if t.kind == "punct" or t.text in _BEFORE_VALUE else "name"
            if t.kind == "punct" and t.text in "([{":
                stack.append((t.text, t.start))
            elif t.kind == "punct" and t.text in ")]}":
                if not stack:
                    return
                opened, place = stack.pop()
                if t.text == ")" and opened == "(":
                    n = self.scan(at) if text[at : at + 1] else t
                    self.arrows[place] = n.text == "=>" and not n.newline
                if not stack:
                    return

    def assignment(self, in_ok: bool = True) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            self.fail(what="nested too deeply")
        out = self._assignment(in_ok)
        self.depth -= 1
        return out

    def _assignment(self, in_ok: bool) -> Node:
        t = self.peek()
        if t.kind == "name" and t.text == "yield":
            word = self.leaf(self.take())
            star, n = self.maybe("*"), self.peek()
            bare = not star and (n.newline or n.kind == "end" or self.is_(")", "]", "}", ",", ";", ":", "in", "of"))
            return self.node("yield_expression", [word, star, None if bare else self.assignment(in_ok)])
        if self.is_("(") and self.arrow_ahead():
            return self.arrow([], self.parameters(), None, in_ok)
        if t.kind == "name" and t.text == "async" and not (s := self.second()).newline:
            if s.text == "(" and self.arrow_ahead():
                return self.arrow([self.leaf(self.take())], self.parameters(), None, in_ok)
            if s.kind == "name" and s.text not in _WORDS and self.scan(s.end).text == "=>":
                return self.arrow([self.leaf(self.take())], None, self.name(), in_ok)
        if t.kind == "name" and t.text not in _WORDS and self.second().text == "=>":
            return self.arrow([], None, self.name(), in_ok)
        left = self.conditional(in_ok)
        if self.peek().kind == "punct" and self.peek().text in _ASSIGN:
            op = self.leaf(self.take())
            if op.kind == "=":
                left = self.as_pattern(left) if left.kind in ("object", "array") else left
            if left.kind not in ("identifier", "member_expression", "subscript_expression", "object_pattern", "array_pattern", "parenthesized_expression", "undefined"):
                self.fail(left.start)
            right = self.assignment(in_ok)
            return self.node("assignment_expression" if op.kind == "=" else "augmented_assignment_expression", [left, op, right], left=left, right=right)
        return left

    def arrow(self, kids: list[Node], params: Node | None, one: Node | None, in_ok: bool) -> Node:
        sign = self.expect("=>")
        body = self.block() if self.is_("{") else self.assignment(in_ok)
        return self.node("arrow_function", [*kids, params, one, sign, body], parameters=params, parameter=one, body=body)

    def conditional(self, in_ok: bool) -> Node:
        test = self.binary(0, in_ok)
        if not self.is_("?"):
            return test
        q = self.leaf(self.take())
        then = self.assignment()
        colon = self.expect(":")
        other = self.assignment(in_ok)
        return self.node("ternary_expression", [test, q, then, colon, other], condition=test, consequence=then, alternative=other)

    def binary(self, least: int, in_ok: bool) -> Node:
        left = self.unary() if self.peek().kind != "private" else self.leaf(self.take(), "private_property_identifier", True)
        while True:
            t = self.peek()
            power = _BINARY.get(t.text, 0) if t.kind in ("punct", "name") else 0
            if power <= least or t.text == "in" and not in_ok:
                return left
            op = self.leaf(self.take())
            right = self.binary(power - (t.text == "**"), in_ok)
            left = self.node("binary_expression", [left, op, right], left=left, operator=op, right=right)

    def unary(self) -> Node:
        t = self.peek()
        if t.kind == "punct" and t.text in ("!", "~", "+", "-") or t.kind == "name" and t.text in ("typeof", "void", "delete"):
            op = self.leaf(self.take())
            return self.node("unary_expression", [op, arg := self.unary()], operator=op, argument=arg)
        if t.kind == "punct" and t.text in ("++", "--"):
            op = self.leaf(self.take())
            return self.node("update_expression", [op, arg := self.unary()], argument=arg)
        if t.kind == "name" and t.text == "await" and (s := self.second()).text not in (")", ";", ",", "=", ".", "]", "}", "=>") and s.kind != "end":
            return self.node("await_expression", [self.leaf(self.take()), self.unary()])
        e = self.postfix()
        if self.is_("++", "--") and not self.peek().newline:
            return self.node("update_expression", [e, self.leaf(self.take())], argument=e)
        return e

    def arguments(self) -> Node:
        kids = [self.expect("(")]
        while not self.is_(")"):
            kids.append(self.spread() if self.is_("...") else self.assignment())
            if not self.is_(")"):
                kids.append(self.expect(","))
        kids.append(self.expect(")"))
        return self.node("arguments", kids)

    def spread(self) -> Node:
        return self.node("spread_element", [self.leaf(self.take()), self.assignment()])

    def postfix(self, calls: bool = True) -> Node:
        e = self.new() if self.is_("new") else self.primary()
        while True:
            t = self.peek()
            if t.kind == "template":
                args = self.template()
                e = self.node("call_expression", [e, args], function=e, arguments=args)
            elif t.kind != "punct":
                return e
            elif t.text == "." or t.text == "?.":
                if t.text == "?." and not calls:
                    return e
                dot = self.leaf(self.take())
                if dot.kind == "?.":
                    dot = Node("optional_chain", dot.start, dot.end)
                    if self.is_("("):
                        args = self.arguments()
                        e = self.node("call_expression", [e, dot, args], function=e, arguments=args, optional_chain=dot)
                        continue
                    if self.is_("["):
                        e = self.subscript(e, dot)
                        continue
                n = self.peek()
                if n.kind not in ("name", "private"):
                    self.fail()
                prop = self.leaf(self.take(), "property_identifier" if n.kind == "name" else "private_property_identifier", True)
                e = self.node("member_expression", [e, dot, prop], object=e, property=prop)
            elif t.text == "[":
                e = self.subscript(e, None)
            elif t.text == "(" and calls:
                args = self.arguments()
                e = self.node("call_expression", [e, args], function=e, arguments=args)
            else:
                return e

    def subscript(self, e: Node, dot: Node | None) -> Node:
        left = self.expect("[")
        index = self.expression()
        return self.node("subscript_expression", [e, dot, left, index, self.expect("]")], object=e, index=index)

    def new(self) -> Node:
        word = self.leaf(self.take())
        if self.is_("."):
            return self.node("meta_property", [word, self.leaf(self.take()), self.leaf(self.take())])
        maker = self.new() if self.is_("new") else self.postfix(False)
        args = self.arguments() if self.is_("(") else None
        return self.node("new_expression", [word, maker, args], constructor=maker, arguments=args)

    def string(self) -> Node:
        t = self.peek()
        if t.kind != "string":
            self.fail()
        self.take()
        inner = [Node("string_fragment", t.start + 1, t.end - 1)] if t.end - t.start > 2 else []
        return Node("string", t.start, t.end, True, [Node(t.text[0], t.start, t.start + 1, False), *inner, Node(t.text[0], t.end - 1, t.end, False)])

    def template(self) -> Node:
        begin = self.take().start
        kids, at, text = [Node("`", begin, begin + 1, False)], begin + 1, self.text
        chunk = at
        while True:
            if at >= len(text):
                self.fail(begin, "template does not end")
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                if at > chunk:
                    kids.append(Node("string_fragment", chunk, at))
                kids.append(Node("`", at, at + 1, False))
                self.at, self.ahead, self.last_end = at + 1, None, at + 1
                return Node("template_string", begin, at + 1, True, kids)
            elif text.startswith("${", at):
                if at > chunk:
                    kids.append(Node("string_fragment", chunk, at))
                self.at, self.ahead = at + 2, None
                inner = self.expression()
                if not self.is_("}"):
                    self.fail()
                close = self.leaf(self.take())
                kids.append(Node("template_substitution", at, close.end, True, [Node("${", at, at + 2, False), inner, close]))
                at = chunk = close.end
            else:
                at += 1

    def primary(self) -> Node:
        t = self.peek()
        if t.kind == "name":
            if t.text == "function" or t.text == "async" and (s := self.second()).text == "function" and not s.newline:
                return self.function("function_expression", False)
            if t.text == "class":
                return self.class_("class_expression", False)
            if t.text in _ATOMS:
                return self.leaf(self.take(), _ATOMS[t.text], True)
            if t.text == "import":
                word = self.leaf(self.take(), "import", True)
                if self.is_("."):
                    return self.node("meta_property", [word, self.leaf(self.take()), self.leaf(self.take())])
                return word
            return self.name()
        if t.kind == "number":
            return self.leaf(self.take(), "number", True)
        if t.kind == "string":
            return self.string()
        if t.kind == "template":
            return self.template()
        if t.kind == "punct":
            if t.text == "(":
                return self.grouped()
            if t.text == "[":
                return self.array()
            if t.text == "{":
                return self.object()
            if t.text == "@":
                return self.class_("class_expression", False)
            if t.text in ("/", "/=") and (m := _REGEX.match(self.text, t.start)):
                self.at, self.ahead, self.last_end = m.end(), None, m.end()
                slash = self.text.rindex("/", t.start, m.end())
                kids = [Node("/", t.start, t.start + 1, False), Node("regex_pattern", t.start + 1, slash), Node("/", slash, slash + 1, False)]
                return Node("regex", t.start, m.end(), True, [*kids, *([Node("regex_flags", slash + 1, m.end())] if slash + 1 < m.end() else [])])
        self.fail()

    def array(self) -> Node:
        kids = [self.expect("[")]
        while not self.is_("]"):
            if self.is_(","):
                kids.append(self.leaf(self.take()))
                continue
            kids.append(self.spread() if self.is_("...") else self.assignment())
            if not self.is_("]"):
                kids.append(self.expect(","))
        kids.append(self.expect("]"))
        return self.node("array", kids)

    def object(self) -> Node:
        kids = [self.expect("{")]
        while not self.is_("}"):
            kids.append(self.spread() if self.is_("...") else self.property())
            if not self.is_("}"):
                kids.append(self.expect(","))
        kids.append(self.expect("}"))
        return self.node("object", kids)

    def property(self) -> Node:
        t, s = self.peek(), self.second()
        if t.kind == "name" and s.text in (",", "}", "="):
            if t.text in _WORDS:
                self.fail()
            key = self.leaf(self.take(), "shorthand_property_identifier", True)
            if self.is_("="):
                eq = self.leaf(self.take())
                right = self.assignment()
                left = Node("shorthand_property_identifier_pattern", key.start, key.end)
                return self.node("object_assignment_pattern", [left, eq, right], left=left, right=right)
            return key
        if self.is_("async", "get", "set", "*") and s.text not in ("(", ":"):
            return self.member()
        key = self.property_name()
        if self.is_("("):
            params = self.parameters()
            body = self.block()
            return self.node("method_definition", [key, params, body], name=key, parameters=params, body=body)
        colon = self.expect(":")
        value = self.assignment()
        return self.node("pair", [key, colon, value], key=key, value=value)

    def as_pattern(self, n: Node) -> Node:
        """An object or array read as the target of an assignment."""
        if n.kind == "object":
            n.kind = "object_pattern"
            for k, c in enumerate(n.children):
                if c.kind == "pair":
                    c.kind = "pair_pattern"
                    v = self.as_pattern(c.fields["value"])
                    c.children[-1] = c.fields["value"] = v
                elif c.kind == "shorthand_property_identifier":
                    c.kind = "shorthand_property_identifier_pattern"
                elif c.kind == "spread_element":
                    n.children[k] = self.as_pattern(c)
                elif c.kind == "method_definition":
                    self.fail(c.start)
        elif n.kind == "array":
            n.kind = "array_pattern"
            n.children = [self.as_pattern(c) if c.named else c for c in n.children]
        elif n.kind == "spread_element":
            n.kind = "rest_pattern"
            n.children[-1] = self.as_pattern(n.children[-1])
        elif n.kind == "assignment_expression":
            n.kind = "assignment_pattern"
            left = self.as_pattern(n.fields["left"])
            n.children[0] = n.fields["left"] = left
        elif n.kind not in ("identifier", "member_expression", "subscript_expression", "object_pattern", "array_pattern", "assignment_pattern", "undefined"):
            self.fail(n.start)
        return n


def parse(text: str) -> Tree:
    """The syntax tree of a whole text; ParseError where it is not JavaScript."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, FRAMES))
    try:
        with steady():
            parser = Parser(text)
            root = parser.program()
            return Tree(text, root, sorted(parser.comments.items()))
    except RecursionError:
        raise ParseError(text, 0, "nested too deeply") from None
    finally:
        sys.setrecursionlimit(limit)
