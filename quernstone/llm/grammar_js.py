"""A grammar of ES modules and TypeScript over folded shapes."""

from __future__ import annotations

import re

from quernstone.llm.grammar import Broken, Parser, fold

_KEYWORDS = frozenset(
    "await async function const let var return if else for of in while switch case break default throw new class extends import export from as typeof instanceof null true false this super interface type enum "
    "implements public private protected readonly static abstract declare try catch finally continue do void delete yield keyof infer is namespace module get set satisfies asserts unique override with debugger".split()
)
_RESERVED = frozenset("function const var return if else for in while switch case break default throw new class extends import export typeof instanceof null true false this super enum try catch finally continue do void delete with debugger".split())
_LEX = re.compile(
    r"(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<t>`(?:[^`\\]|\\[\s\S])*`)|"
    r"(?P<r>(?:(?<=[=(,:\[!&|?{};+\n])|(?<=return)|(?<=case))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"
)
_NAME = re.compile(r"(?<![\w$#])(?!(?:" + "|".join(sorted(_KEYWORDS)) + r")(?![\w$]))[#]?[A-Za-z_$ª-ￜ][\w$]*")
_NUMBER = re.compile(r"(?<![\w$])(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])")
_SPACE = re.compile(r"[ \t\r\f\v ﻿]+")
_TIGHT = re.compile(r" ?(\n|=>|[{}()\[\],;:?.=<>+\-*/%&|^!~@]) ?")
_BREAKS = re.compile(r"\n+")
_MANY = re.compile(r"(?: ?[0SiT] ?,\n?){6,}")
_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)
_HASHBANG = re.compile(r"\A#![^\n]*")


def shape(text: str) -> str:
    """The text as a shape, before folding."""

    def one(m: re.Match) -> str:
        kind = m.lastgroup
        if kind == "s":
            return "\x01"
        if kind == "t":
            return "\x02"
        if kind == "c":
            return "\n" if "\n" in m.group() else " "
        return "\x03"

    out = _LEX.sub(one, _HASHBANG.sub("", text))
    if _CONFLICT.search(out):
        raise Broken
    out = _NUMBER.sub("0", _NAME.sub("i", out))
    out = _TIGHT.sub(r"\1", _SPACE.sub(" ", out))
    out = _BREAKS.sub("\n", out).replace("\x01", " S ").replace("\x02", " T ").replace("\x03", " R ")
    return _MANY.sub(lambda m: m.group().replace(" ", "")[:2] * 2, out)


class Js(Parser):
    """types: whether type annotations are allowed; jsx: whether elements are."""

    tokens = re.compile(r"=>|>(?==>)|\.\.\.|\?\.(?!\d)|\?\?=?|\*\*=?|&&=?|\|\|=?|===|!==|==|!=|<=|>=|>>>=|<<=|>>=|\+\+|--|[+\-*/%&|^]=|[A-Za-z]+|0|\n|[^\s]")

    single = {"program": ("statement", True), "body": ("statement", False), "members": ("member",)}

    def __init__(self, types: bool, jsx: bool):
        super().__init__()
        self.types, self.jsx = types, jsx

    def check(self, text: str) -> bool:
        """Whether the whole text is valid."""
        try:
            s = shape(text)
            if re.search(r"[\"'`\\]", s):
                return False
            try:
                s = fold(s, self.groups)
            except OverflowError:
                self.reset()
                s = fold(s, self.groups)
        except Broken:
            return False
        if re.search(r"[{}()\[\]]", s):
            return False
        return self.lines("program", s)

    # -- lists
    def nl(self) -> None:
        while self.t[self.p] == "\n":
            self.p += 1

    def end(self) -> None:
        """The end of a statement: ; or a line's end or the end."""
        if not (self.take(";") or self.at("", "\n")):
            raise Broken

    def program(self) -> None:
        self.statements(True)

    def block(self) -> None:
        """Inside of { }: statements, line by line where that works."""
        text = self.body_text()
        if not self.lines("body", text):
            raise Broken

    def body_text(self) -> str:
        text = "".join(x + " " if x.isalpha() else x for x in self.t[self.p : -1])
        self.p = len(self.t) - 1
        return text

    def body(self) -> None:
        self.statements(False)

    def statements(self, top: bool) -> None:
        self.nl()
        while not self.at(""):
            self.statement(top)
            self.nl()

    def name(self) -> None:
        t = self.t[self.p]
        if t == "i" or (t in _KEYWORDS and t not in _RESERVED):
            self.p += 1
        else:
            raise Broken

    def any_name(self) -> None:
        if not self.t[self.p].isalpha() or self.t[self.p] in ("S", "T", "R"):
            raise Broken
        self.p += 1

    # -- statements
    def statement(self, top: bool = False) -> None:
        t = self.t[self.p]
        if t == ";":
            self.p += 1
            return
        if t == "@":
            while self.take("@"):
                self.unary_chain()
                self.nl()
            return self.statement(top)
        if t == "import" and self.t[self.p + 1] not in (".",) and self.groups.inside.get(self.t[self.p + 1], " ")[0] != "(":
            if not top:
                raise Broken
            return self.import_()
        if t == "export":
            if not top:
                raise Broken
            return self.export()
        if t in ("const", "var", "let") and (self.t[self.p + 1] in ("i", "async", "get", "set", "of", "type", "from", "as", "is", "module", "namespace", "static", "public", "private", "readonly", "declare", "abstract", "keyof", "await", "infer", "unique", "override") or self.groups.inside.get(self.t[self.p + 1], " ")[0] in "{["):
            self.declaration()
            return self.end()
        if t == "const" and self.t[self.p + 1] == "enum" and self.types:
            self.p += 1
            return self.enum()
        if t == "function" or (t == "async" and self.t[self.p + 1] == "function"):
            return self.function(False)
        if t == "class":
            return self.class_(False)
        if t == "if":
            self.p += 1
            self.inner("(", "expression_all")
            self.nl()
            self.statement()
            p = self.p
            self.nl()
            if self.take("else"):
                self.nl()
                self.statement()
            else:
                self.p = p
            return None
        if t == "for":
            self.p += 1
            self.take("await")
            self.inner("(", "for_head")
            self.nl()
            return self.statement()
        if t == "while":
            self.p += 1
            self.inner("(", "expression_all")
            self.nl()
            return self.statement()
        if t == "do":
            self.p += 1
            self.nl()
            self.statement()
            self.nl()
            self.need("while")
            self.inner("(", "expression_all")
            self.take(";")
            return None
        if t == "switch":
            self.p += 1
            self.inner("(", "expression_all")
            self.nl()
            return self.inner("{", "cases")
        if t == "try":
            self.p += 1
            self.inner("{", "block")
            p = self.p
            self.nl()
            some = False
            if self.take("catch"):
                some = True
                if self.bracket() == "(":
                    self.inner("(", "parameters")
                self.inner("{", "block")
                p = self.p
                self.nl()
            if self.take("finally"):
                some = True
                self.inner("{", "block")
                p = self.p
            self.p = p
            if not some:
                raise Broken
            return None
        if t in ("return", "throw"):
            self.p += 1
            if not self.at("", ";", "\n"):
                self.expression()
            elif t == "throw":
                raise Broken
            return self.end()
        if t in ("break", "continue"):
            self.p += 1
            if self.at("i"):
                self.p += 1
            return self.end()
        if t == "debugger":
            self.p += 1
            return self.end()
        if self.types:
            if t == "interface" and self.t[self.p + 1].isalpha():
                return self.interface()
            if t == "type" and self.t[self.p + 1].isalpha() and self.t[self.p + 1] not in ("of", "in", "instanceof"):
                return self.alias()
            if t == "enum":
                return self.enum()
            if t in ("declare", "abstract") and self.t[self.p + 1].isalpha():
                self.p += 1
                return self.statement(top)
            if t in ("namespace", "module") and self.t[self.p + 1] in ("i", "S"):
                self.p += 2
                while self.take("."):
                    self.any_name()
                return self.inner("{", "module_body")
        if self.bracket() == "{":
            p = self.p
            if self.attempt(lambda: self.inner("{", "block")):
                return None
            self.p = p
            raise Broken
        if t == "i" and self.t[self.p + 1] == ":":
            self.p += 2
            self.nl()
            return self.statement()
        self.expression()
        return self.end()

    def module_body(self) -> None:
        self.statements(True)

    def import_(self) -> None:
        self.need("import")
        if self.take("S"):
            return self.end()
        if self.types and self.at("type") and self.t[self.p + 1] != "from":
            self.p += 1
        if self.at("i") or self.t[self.p] in _KEYWORDS:
            self.name()
            if self.types and self.take("="):
                self.expression()
                return self.end()
            if not self.take(","):
                self.need("from")
                self.need("S")
                return self.end()
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            self.inner("{", "specifiers")
        self.nl()
        self.need("from")
        self.need("S")
        if self.take("with"):
            self.inner("{", "object")
        return self.end()

    def specifiers(self) -> None:
        self.nl()
        while not self.at(""):
            if self.types and self.at("type") and self.t[self.p + 1].isalpha():
                self.p += 1
            if not self.take("S"):
                self.any_name()
            if self.take("as"):
                if not self.take("S"):
                    self.any_name()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def export(self) -> None:
        self.need("export")
        if self.take("default"):
            if self.at("function") or (self.at("async") and self.t[self.p + 1] == "function"):
                return self.function(True)
            if self.at("class") or (self.at("abstract") and self.t[self.p + 1] == "class"):
                self.take("abstract")
                return self.class_(True)
            if self.types and self.at("interface"):
                return self.interface()
            self.assignment()
            return self.end()
        if self.take("*"):
            if self.take("as"):
                self.any_name()
            self.need("from")
            self.need("S")
            return self.end()
        if self.types and self.at("type") and (self.groups.inside.get(self.t[self.p + 1], " ")[0] == "{" or self.t[self.p + 1] == "*"):
            self.p += 1
        if self.bracket() == "{":
            self.inner("{", "specifiers")
            if self.take("from"):
                self.need("S")
            return self.end()
        if self.types and self.take("="):
            self.expression()
            return self.end()
        if self.at("const", "let", "var", "function", "async", "class", "abstract", "interface", "type", "enum", "declare", "namespace", "module", "@"):
            if not self.types and self.at("abstract", "interface", "type", "enum", "declare", "namespace", "module"):
                raise Broken
            return self.statement(False)
        raise Broken

    def declaration(self, in_head: bool = False) -> None:
        self.p += 1
        while True:
            self.nl()
            self.binding()
            if self.types and self.take("!"):
                pass
            self.annotation()
            if self.take("="):
                self.nl()
                self.assignment()
            if not self.take(","):
                return

    def binding(self) -> None:
        b = self.bracket()
        if b == "{":
            self.inner("{", "object_pattern")
        elif b == "[":
            self.inner("[", "array_pattern")
        else:
            self.name()

    def object_pattern(self) -> None:
        self.nl()
        while not self.at(""):
            if self.take("..."):
                self.name()
            else:
                if self.bracket() == "[":
                    self.inner("[", "expression_all")
                elif not self.take("S", "0"):
                    self.any_name()
                if self.take(":"):
                    self.nl()
                    self.binding()
                if self.take("="):
                    self.assignment()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def array_pattern(self) -> None:
        self.nl()
        while not self.at(""):
            if self.take(","):
                self.nl()
                continue
            self.take("...")
            self.binding()
            if self.take("="):
                self.assignment()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def annotation(self) -> None:
        if self.types and self.take(":"):
            self.nl()
            self.type_()

    def function(self, anonymous: bool) -> None:
        self.take("async")
        self.need("function")
        self.take("*")
        if self.at("i") or self.t[self.p] in _KEYWORDS:
            self.name()
        elif not anonymous:
            raise Broken
        self.signature()
        if self.bracket() == "{":
            self.inner("{", "block")
        elif self.types:
            self.end()
        else:
            raise Broken

    def signature(self) -> None:
        if self.types and self.at("<"):
            self.type_parameters()
        self.inner("(", "parameters")
        if self.types and self.take(":"):
            self.return_type()

    def return_type(self) -> None:
        self.nl()
        if self.at("asserts") and self.t[self.p + 1].isalpha():
            self.p += 1
        if self.t[self.p] in ("i", "this") and self.t[self.p + 1] == "is":
            self.p += 2
        self.type_()

    def parameters(self) -> None:
        self.nl()
        while not self.at(""):
            while self.take("@"):
                self.unary_chain()
                self.nl()
            if self.types:
                while self.at("public", "private", "protected", "readonly", "override") and (self.t[self.p + 1].isalpha()):
                    self.p += 1
            self.take("...")
            if self.types and self.at("this") and self.t[self.p + 1] == ":":
                self.p += 1
            else:
                self.binding()
            if self.types:
                self.take("?")
            self.annotation()
            if self.take("="):
                self.nl()
                self.assignment()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def class_(self, anonymous: bool) -> None:
        self.need("class")
        if self.at("i") or (self.t[self.p] in _KEYWORDS and self.t[self.p] not in ("extends", "implements")):
            self.name()
            if self.types and self.at("<"):
                self.type_parameters()
        elif not anonymous:
            raise Broken
        if self.take("extends"):
            self.unary_chain()
            if self.types and self.at("<"):
                self.type_arguments()
        if self.types and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.nl()
        self.inner("{", "class_body")

    def class_body(self) -> None:
        if not self.lines("members", self.body_text()):
            raise Broken

    def members(self) -> None:
        self.nl()
        while not self.at(""):
            self.member()
            self.nl()

    def member(self) -> None:
        if self.take(";"):
            return
        while self.take("@"):
            self.unary_chain()
            self.nl()
        if self.at("static") and self.groups.inside.get(self.t[self.p + 1], " ")[0] == "{":
            self.p += 1
            return self.inner("{", "block")
        modifiers = ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare")
        while self.at(*modifiers):
            if not self.types and self.at("public", "private", "protected", "readonly", "abstract", "override", "declare"):
                break
            nxt = self.t[self.p + 1]
            if not (nxt.isalpha() or nxt in ("*", "0") or self.groups.inside.get(nxt, " ")[0] == "["):
                break
            self.p += 1
        self.take("*")
        if self.bracket() == "[":
            self.inner("[", "expression_all", *(["index_signature"] if self.types else []))
        elif not self.take("S", "0"):
            self.any_name()
        if self.types:
            self.take("?", "!")
        if self.bracket() == "(" or (self.types and self.at("<")):
            self.signature()
            if self.bracket() == "{":
                return self.inner("{", "block")
            if self.types:
                return self.end()
            raise Broken
        self.annotation()
        if self.take("="):
            self.nl()
            self.assignment()
        return self.end()

    def for_head(self) -> None:
        self.nl()
        if self.at("const", "let", "var"):
            self.p += 1
            self.binding()
            self.annotation()
            if self.take("of", "in"):
                return self.expression()
            if self.take("="):
                self.assignment()
            while self.take(","):
                self.binding()
                self.annotation()
                if self.take("="):
                    self.assignment()
        elif not self.at(";"):
            self.expression()
            if self.take("of", "in"):
                return self.expression()
        self.nl()
        self.need(";")
        self.nl()
        if not self.at(";"):
            self.expression()
        self.nl()
        self.need(";")
        self.nl()
        if not self.at(""):
            self.expression()
        self.nl()
        return None

    def cases(self) -> None:
        self.nl()
        while not self.at(""):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            self.nl()
            while not self.at("", "case", "default"):
                self.statement()
                self.nl()

    # -- expressions
    def expression_all(self) -> None:
        self.nl()
        self.expression()
        self.nl()

    def expression(self) -> None:
        self.assignment()
        while True:
            p = self.p
            self.nl()
            if not self.take(","):
                self.p = p
                return
            self.nl()
            self.assignment()

    def elements(self) -> None:
        self.nl()
        while not self.at(""):
            if self.take(","):
                self.nl()
                continue
            self.take("...")
            self.assignment()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def arguments(self) -> None:
        self.nl()
        while not self.at(""):
            self.take("...")
            self.assignment()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def object(self) -> None:
        self.nl()
        while not self.at(""):
            if self.take("..."):
                self.assignment()
            else:
                plain = False
                while self.at("async", "get", "set") and (self.t[self.p + 1].isalpha() or self.groups.inside.get(self.t[self.p + 1], " ")[0] == "[" or self.t[self.p + 1] in ("*", "0")):
                    self.p += 1
                self.take("*")
                if self.bracket() == "[":
                    self.inner("[", "expression_all")
                elif not self.take("S", "0"):
                    plain = self.t[self.p] == "i" or self.t[self.p] not in _RESERVED
                    self.any_name()
                if self.bracket() == "(" or (self.types and self.at("<")):
                    self.signature()
                    self.inner("{", "block")
                elif self.take(":"):
                    self.nl()
                    self.assignment()
                elif plain:
                    if self.take("="):
                        self.assignment()
                else:
                    raise Broken
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        p = self.p
        if self.at("async") and self.t[self.p + 1] != "=>":
            self.p += 1
        if self.at("i") or (self.t[self.p] in _KEYWORDS and self.t[self.p] not in _RESERVED):
            if self.t[self.p + 1] == "=>":
                self.p += 2
                self.arrow_body()
                return True
            self.p = p
            return False
        ok = self.bracket() == "(" or (self.types and self.at("<"))
        if ok:
            try:
                if self.at("<"):
                    self.type_parameters()
                self.inner("(", "parameters")
                if self.types and self.take(":"):
                    self.return_type()
                self.need("=>")
            except Broken:
                self.p = p
                return False
            self.arrow_body()
            return True
        self.p = p
        return False

    def arrow_body(self) -> None:
        self.nl()
        if self.bracket() == "{":
            self.inner("{", "block")
        else:
            self.assignment()

    _ASSIGN = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="))
    _BINARY = frozenset(("+", "-", "*", "/", "%", "**", "&", "|", "^", "&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "instanceof", "in"))

    def assignment(self) -> None:
        if self.at("yield"):
            self.p += 1
            self.take("*")
            if not self.at("", ";", ",", "\n"):
                self.assignment()
            return
        if self.arrow():
            return
        start = self.p
        self.unary()
        if self.t[self.p] in self._ASSIGN:
            # Only what can be assigned to: a name, a member or a pattern.
            last = self.t[self.p - 1]
            if last in ("S", "0", "T", "R") or (self.groups.inside.get(last, " ")[0] == "(" and self.p - start > 1):
                raise Broken
            self.p += 1
            self.nl()
            self.assignment()
            return
        while True:
            p = self.p
            self.nl()
            t = self.t[self.p]
            if t in self._BINARY:
                if t == "in" and self.no_in():
                    self.p = p
                    return
                self.p += 1
                if t in ("<", ">") and self.at("<", ">"):
                    while self.take("<", ">"):
                        pass
                self.nl()
                self.unary()
            elif self.types and p == self.p and t in ("as", "satisfies"):
                self.p += 1
                if not self.take("const"):
                    self.type_()
            elif t == "?":
                self.p += 1
                self.nl()
                self.assignment()
                self.nl()
                self.need(":")
                self.nl()
                self.assignment()
                return
            else:
                self.p = p
                return

    def no_in(self) -> bool:
        return False

    def unary(self) -> None:
        while self.at("!", "~", "+", "-", "typeof", "void", "delete", "await", "++", "--"):
            self.p += 1
        if self.types and not self.jsx and self.at("<"):
            self.p += 1
            self.type_()
            self.need(">")
            return self.unary()
        self.unary_chain()
        if self.at("++", "--"):
            self.p += 1
        return None

    def unary_chain(self) -> None:
        t = self.t[self.p]
        b = self.bracket()
        if t == "new":
            self.p += 1
            if self.take("."):
                self.any_name()
            else:
                self.unary_chain()
                return
        elif t in ("function", "async") and (t == "function" or self.t[self.p + 1] == "function"):
            self.function(True)
        elif t == "class":
            self.class_(True)
        elif t in ("this", "super", "null", "true", "false", "S", "0", "T", "R"):
            self.p += 1
        elif t == "import":
            self.p += 1
            if not self.at(".") and self.bracket() != "(":
                raise Broken
        elif b == "(":
            self.inner("(", "expression_all")
        elif b == "[":
            self.inner("[", "elements")
        elif b == "{":
            self.inner("{", "object")
        elif t == "<" and self.jsx:
            self.element()
        elif t == "i" or (t in _KEYWORDS and t not in _RESERVED):
            self.p += 1
        else:
            raise Broken
        while True:
            p = self.p
            self.nl()
            if self.take(".", "?."):
                if self.bracket() in ("(", "["):
                    if self.t[self.p - 1] != "?.":
                        raise Broken
                    self.inner(self.bracket(), "arguments" if self.bracket() == "(" else "expression_all")
                else:
                    self.any_name()
                continue
            if p != self.p:
                # Only a member's dot may follow a line's end here; a bracket would also join the lines.
                if self.bracket() in ("(", "["):
                    self.inner(self.bracket(), "arguments" if self.bracket() == "(" else "expression_all")
                    continue
                self.p = p
                return
            b = self.bracket()
            if b == "(":
                self.inner("(", "arguments")
            elif b == "[":
                self.inner("[", "expression_all")
            elif self.at("T"):
                self.p += 1
            elif self.types and self.at("!") and self.t[self.p + 1] not in ("=",):
                self.p += 1
            elif self.types and self.at("<"):
                if not self.attempt(self.call_types):
                    return
            else:
                return

    def call_types(self) -> None:
        self.type_arguments()
        if self.bracket() != "(" and not self.at("T", "", ";", ",", "\n", ")", "."):
            raise Broken
        if self.bracket() == "(":
            self.inner("(", "arguments")

    # -- elements
    def element(self) -> None:
        self.need("<")
        if self.take(">"):
            return self.children(True)
        self.tag()
        while not self.at("/", ">"):
            self.nl()
            if self.bracket() == "{":
                self.inner("{", "spread")
            elif self.at("/", ">"):
                break
            else:
                self.any_name()
                while self.take("-", ":"):
                    self.any_name()
                if self.take("="):
                    if not self.take("S"):
                        self.inner("{", "expression_all")
        if self.take("/"):
            return self.need(">")
        self.need(">")
        return self.children(False)

    def tag(self) -> None:
        self.any_name()
        while self.take(".", "-", ":"):
            self.any_name()

    def spread(self) -> None:
        self.nl()
        self.need("...")
        self.assignment()
        self.nl()

    def child(self) -> None:
        self.nl()
        if not self.at(""):
            self.take("...")
            self.expression()
        self.nl()

    def children(self, bare: bool) -> None:
        while True:
            if self.at("<"):
                if self.t[self.p + 1] == "/":
                    self.p += 2
                    if not bare:
                        self.tag()
                    return self.need(">")
                self.element()
            elif self.bracket() == "{":
                self.inner("{", "child")
            elif self.at("", ">"):
                raise Broken
            else:
                self.p += 1

    # -- types
    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.nl()
            self.type_()
            self.nl()
            if not self.take(","):
                break
            if self.at(">"):
                break
        self.close_angle()

    def close_angle(self) -> None:
        if not self.take(">"):
            if self.at(">=", ">>="):
                self.t[self.p] = self.t[self.p][1:]
                return
            raise Broken

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            self.nl()
            self.take("const", "in", "out")
            self.name()
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            self.nl()
            if not self.take(","):
                break
            if self.at(">"):
                break
        self.close_angle()

    def type_(self) -> None:
        p = self.p
        self.nl()
        self.take("|", "&")
        self.type_postfix()
        while True:
            p = self.p
            self.nl()
            if self.take("|", "&"):
                self.nl()
                self.type_postfix()
            elif self.take("extends"):
                self.type_()
                self.nl()
                self.need("?")
                self.type_()
                self.nl()
                self.need(":")
                self.type_()
                return
            else:
                self.p = p
                return

    def type_postfix(self) -> None:
        while self.at("keyof", "readonly", "unique", "infer", "asserts") and (self.t[self.p + 1].isalpha() or self.bracket() or self.groups.inside.get(self.t[self.p + 1])):
            self.p += 1
        self.type_primary()
        while self.bracket() == "[":
            self.inner("[", "empty", "type_all")

    def empty(self) -> None:
        self.nl()

    def type_all(self) -> None:
        self.nl()
        self.type_()
        self.nl()

    def type_primary(self) -> None:
        t, b = self.t[self.p], self.bracket()
        if t == "new" or (t == "abstract" and self.t[self.p + 1] == "new"):
            self.take("abstract")
            self.p += 1
            b = self.bracket()
            t = self.t[self.p]
        if t == "<":
            self.type_parameters()
            b = self.bracket()
        if b == "(":
            p = self.p
            nxt = self.t[self.p + 1]
            if nxt == "=>":
                self.inner("(", "parameters")
                self.need("=>")
                return self.return_type()
            self.p = p
            return self.inner("(", "type_all")
        if b == "{":
            return self.inner("{", "type_body", "mapped")
        if b == "[":
            return self.inner("[", "tuple")
        if t == "typeof":
            self.p += 1
            if self.take("import"):
                self.inner("(", "arguments")
            else:
                self.any_name()
            while self.take("."):
                self.any_name()
            if self.at("<"):
                self.type_arguments()
            return None
        if t == "import":
            self.p += 1
            self.inner("(", "arguments")
            while self.take("."):
                self.any_name()
            if self.at("<"):
                self.type_arguments()
            return None
        if t == "-":
            self.p += 1
            return self.need("0")
        if t in ("S", "0", "T", "null", "true", "false", "void", "this"):
            self.p += 1
            return None
        self.name()
        while self.take("."):
            self.any_name()
        if self.at("<"):
            self.type_arguments()
        return None

    def tuple(self) -> None:
        self.nl()
        while not self.at(""):
            self.take("...")
            if self.t[self.p].isalpha() and self.t[self.p + 1] == ":":
                self.p += 2
            elif self.t[self.p].isalpha() and self.t[self.p + 1] == "?" and self.t[self.p + 2] == ":":
                self.p += 3
            self.type_()
            self.take("?")
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def index_signature(self) -> None:
        self.name()
        self.need(":")
        self.type_()

    def mapped(self) -> None:
        self.nl()
        self.take("+", "-")
        self.take("readonly")
        self.inner("[", "mapped_key")
        self.take("+", "-")
        self.take("?")
        self.annotation()
        self.take(";", ",")
        self.nl()

    def mapped_key(self) -> None:
        self.name()
        self.need("in")
        self.type_()
        if self.take("as"):
            self.type_()

    def type_body(self) -> None:
        self.nl()
        while not self.at(""):
            while self.at("readonly", "get", "set", "static") and (self.t[self.p + 1].isalpha() or self.groups.inside.get(self.t[self.p + 1], " ")[0] == "["):
                self.p += 1
            if self.bracket() == "(" or self.at("<"):
                self.signature()
            elif self.at("new") and self.groups.inside.get(self.t[self.p + 1], " ")[0] == "(":
                self.p += 1
                self.signature()
            else:
                if self.bracket() == "[":
                    self.inner("[", "index_signature", "expression_all")
                elif not self.take("S", "0"):
                    self.any_name()
                self.take("?")
                if self.bracket() == "(" or self.at("<"):
                    self.signature()
                else:
                    self.annotation()
            if not (self.take(";", ",") or self.at("\n", "")):
                raise Broken
            self.nl()
        self.nl()

    def interface(self) -> None:
        self.need("interface")
        self.name()
        if self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.type_()
            while self.take(","):
                self.type_()
        self.nl()
        self.inner("{", "type_body")

    def alias(self) -> None:
        self.need("type")
        self.name()
        if self.at("<"):
            self.type_parameters()
        self.need("=")
        self.type_()
        self.end()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.inner("{", "enum_body")

    def enum_body(self) -> None:
        self.nl()
        while not self.at(""):
            if not self.take("S"):
                self.any_name()
            if self.take("="):
                self.assignment()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()
