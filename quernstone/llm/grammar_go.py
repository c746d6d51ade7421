"""A grammar of Go over folded shapes."""

from __future__ import annotations

import re

from quernstone.llm.grammar import Broken, Parser, fold

_KEYWORDS = frozenset("package import func type struct interface map chan go defer return if else for range switch case default break continue var const fallthrough goto select".split())
_LEX = re.compile(r"(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`)|(?P<r>'(?:[^'\\\n]|\\.[0-9a-fA-F]*)')")
_NAME = re.compile(r"(?<![\w\x01\x02])(?!(?:" + "|".join(sorted(_KEYWORDS)) + r")(?!\w))[A-Za-z_À-ￜ]\w*")
_NUMBER = re.compile(r"(?<![\w\x01\x02])(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w)")
_SPACE = re.compile(r"[ \t\r]+")
_TIGHT = re.compile(r" ?(\n|[{}()\[\],;:.=<>+\-*/%&|^!]) ?")
_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)
_MANY = re.compile(r"(?:(?:S:)?[0S],\n?){8,}")
_ENDS = frozenset(("i", "0", "S", "return", "break", "continue", "fallthrough", "++", "--"))


def shape(text: str) -> str:
    def one(m: re.Match) -> str:
        if m.lastgroup == "c":
            return "\n" if "\n" in m.group() else " "
        return "\x01" if m.lastgroup == "s" else "\x02"

    out = _LEX.sub(one, text)
    if _CONFLICT.search(out):
        raise Broken
    out = _NUMBER.sub("0", _NAME.sub("i", out))
    out = _TIGHT.sub(r"\1", _SPACE.sub(" ", out)).replace("\x01", "S").replace("\x02", "0")
    out = re.sub(r"\n+", "\n", out)
    return _MANY.sub(lambda m: m.group().split(",", 2)[0] + "," + m.group().split(",", 2)[1] + ",", out)


class Go(Parser):
    tokens = re.compile(r":=|\.\.\.|<-|&\^=|<<=|>>=|&&|\|\||\+\+|--|[+\-*/%&|^]=|==|!=|<=|>=|<<|>>|&\^|[A-Za-z]+|0|\n|[^\s]")

    single = {"declarations": ("declaration", True), "statements": ("statement",)}
    between = ("\n", ";")

    def check(self, text: str) -> bool:
        try:
            s = shape(text)
            if re.search(r"[\"'`\\@#$?]", s):
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
        s = s.strip("\n;")
        head, _, rest = s.partition("\n")
        return self.fits("package_clause", head) and self.lines("declarations", rest)

    def nl(self) -> None:
        while self.at("\n"):
            self.p += 1

    def sep(self) -> None:
        while self.at("\n", ";"):
            self.p += 1

    def end(self) -> None:
        if not (self.take(";") or self.at("\n", "")):
            raise Broken

    def package_clause(self) -> None:
        self.need("package")
        self.need("i")
        self.take(";")

    def declarations(self) -> None:
        self.sep()
        while not self.at(""):
            self.declaration(True)
            self.sep()

    def declaration(self, top: bool) -> None:
        if self.take("import"):
            if not top:
                raise Broken
            if self.bracket() == "(":
                self.inner("(", "import_list")
            else:
                self.import_one()
        elif self.take("func"):
            if not top:
                raise Broken
            if self.bracket() == "(" and self.t[self.p + 1] == "i":
                self.inner("(", "parameters")
            self.need("i")
            if self.bracket() == "[":
                self.inner("[", "parameters")
            self.signature()
            if self.bracket() == "{":
                self.inner("{", "block")
        elif self.at("var", "const"):
            self.p += 1
            if self.bracket() == "(":
                self.inner("(", "value_list")
            else:
                self.value_spec()
        elif self.take("type"):
            if self.bracket() == "(":
                self.inner("(", "type_list")
            else:
                self.type_spec()
        else:
            raise Broken
        self.end()

    def import_list(self) -> None:
        self.sep()
        while not self.at(""):
            self.import_one()
            self.end()
            self.sep()

    def import_one(self) -> None:
        self.take("i", ".")
        self.need("S")

    def value_list(self) -> None:
        self.sep()
        while not self.at(""):
            self.value_spec()
            self.end()
            self.sep()

    def value_spec(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")
        if not self.at("=", "\n", ";", ""):
            self.type_()
        if self.take("="):
            self.expressions()

    def type_list(self) -> None:
        self.sep()
        while not self.at(""):
            self.type_spec()
            self.end()
            self.sep()

    def type_spec(self) -> None:
        self.need("i")
        if self.bracket() == "[":
            p = self.p
            if not self.attempt(lambda: (self.inner("[", "parameters"), self.take("="), self.type_())):
                self.p = p
                self.type_()
            return
        self.take("=")
        self.type_()

    def signature(self) -> None:
        self.inner("(", "parameters")
        if self.bracket() == "(":
            self.inner("(", "parameters")
        elif not self.at("", "\n", ";", ",", "=", ":=", "S") and self.bracket() != "{":
            self.type_()

    def parameters(self) -> None:
        self.nl()
        while not self.at(""):
            if self.at("i") and self.t[self.p + 1] not in (",", "", ".", "\n"):
                self.p += 1
                self.take("...")
                self.union()
            else:
                self.take("...")
                self.union()
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def union(self) -> None:
        self.take("~")
        self.type_()
        while self.take("|"):
            self.take("~")
            self.type_()

    def type_(self) -> None:
        b = self.bracket()
        if self.take("*"):
            self.type_()
        elif b == "[":
            self.inner("[", "empty", "array_size")
            self.type_()
        elif self.take("map"):
            self.inner("[", "type_all")
            self.type_()
        elif self.take("<-"):
            self.need("chan")
            self.type_()
        elif self.take("chan"):
            self.take("<-")
            self.type_()
        elif self.take("func"):
            self.signature()
        elif self.take("struct"):
            self.inner("{", "fields")
        elif self.take("interface"):
            self.inner("{", "methods")
        elif b == "(":
            self.inner("(", "type_all")
        else:
            self.need("i")
            if self.take("."):
                self.need("i")
            if self.bracket() == "[":
                self.attempt(lambda: self.inner("[", "type_arguments"))

    def empty(self) -> None:
        self.nl()

    def array_size(self) -> None:
        if not self.take("..."):
            self.expression()

    def type_all(self) -> None:
        self.nl()
        self.type_()
        self.nl()

    def type_arguments(self) -> None:
        self.nl()
        self.type_()
        while self.take(","):
            self.nl()
            self.type_()
        self.nl()

    def fields(self) -> None:
        self.sep()
        while not self.at(""):
            if self.take("*"):
                self.type_()
            else:
                self.need("i")
                if self.at(",", "i", "*", "map", "chan", "func", "struct", "interface", "<-") or self.bracket() in ("[", "("):
                    while self.take(","):
                        self.need("i")
                    self.type_()
                elif self.take("."):
                    self.need("i")
            self.take("S")
            self.end()
            self.sep()

    def methods(self) -> None:
        self.sep()
        while not self.at(""):
            if self.at("i") and self.groups.inside.get(self.t[self.p + 1], " ")[0] == "(":
                self.p += 1
                self.signature()
            else:
                self.union()
            self.end()
            self.sep()

    # -- statements
    def block(self) -> None:
        text = "".join(x + " " if x.isalpha() else x for x in self.t[self.p : -1])
        self.p = len(self.t) - 1
        if not self.lines("statements", text):
            raise Broken

    def statements(self) -> None:
        self.sep()
        while not self.at(""):
            self.statement()
            self.sep()

    def statement(self) -> None:
        t = self.t[self.p]
        if t in ("var", "const", "type"):
            return self.declaration(False)
        if t == "return":
            self.p += 1
            if not self.at("\n", ";", ""):
                self.expressions()
            return self.end()
        if t in ("go", "defer"):
            self.p += 1
            self.expression()
            return self.end()
        if t in ("break", "continue", "goto"):
            self.p += 1
            self.take("i")
            return self.end()
        if t == "fallthrough":
            self.p += 1
            return self.end()
        if t == "if":
            return self.if_()
        if t == "for":
            self.p += 1
            if self.bracket() != "{":
                if not self.attempt(self.range_head):
                    if not self.at(";"):
                        self.simple(True)
                    if self.take(";"):
                        if not self.at(";"):
                            self.simple(True)
                        self.need(";")
                        if self.bracket() != "{":
                            self.simple(True)
            self.inner("{", "block")
            return self.end()
        if t == "switch":
            self.p += 1
            if self.bracket() != "{":
                self.simple(True)
                if self.take(";") and self.bracket() != "{":
                    self.simple(True)
            self.inner("{", "cases")
            return self.end()
        if t == "select":
            self.p += 1
            self.inner("{", "cases")
            return self.end()
        if self.bracket() == "{":
            self.inner("{", "block")
            return self.end()
        if t == "i" and self.t[self.p + 1] == ":" and self.t[self.p + 2] in ("\n", ""):
            self.p += 2
            return None
        self.simple(False)
        return self.end()

    def if_(self) -> None:
        self.need("if")
        self.simple(True)
        if self.take(";"):
            self.simple(True)
        self.inner("{", "block")
        if self.take("else"):
            if self.at("if"):
                return self.if_()
            self.inner("{", "block")
        return self.end()

    def range_head(self) -> None:
        if not self.at("range"):
            self.expressions(True)
            self.need(":=", "=")
        self.need("range")
        self.expression(True)

    def simple(self, head: bool) -> None:
        self.expressions(head)
        if self.take(":=", "=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="):
            self.nl()
            self.expressions(head)
        elif self.take("++", "--"):
            pass
        elif self.take("<-"):
            self.expression(head)

    def cases(self) -> None:
        self.sep()
        while not self.at(""):
            if self.take("case"):
                self.nl()
                if not self.attempt(lambda: (self.simple(False), self.need(":"))):
                    self.type_()
                    while self.take(","):
                        self.type_()
                    self.need(":")
            else:
                self.need("default")
                self.need(":")
            self.sep()
            while not self.at("", "case", "default"):
                self.statement()
                self.sep()

    # -- expressions
    def expressions(self, head: bool = False) -> None:
        self.expression(head)
        while self.take(","):
            self.nl()
            self.expression(head)

    def expression(self, head: bool = False) -> None:
        self.unary(head)
        while self.at("||", "&&", "==", "!=", "<", "<=", ">", ">=", "+", "-", "|", "^", "*", "/", "%", "<<", ">>", "&", "&^"):
            self.p += 1
            self.nl()
            self.unary(head)

    def expression_all(self) -> None:
        self.nl()
        self.expression()
        self.nl()

    def index(self) -> None:
        self.nl()
        if not self.at(":"):
            if not self.attempt(lambda: self.expressions()):
                self.type_arguments()
        while self.take(":"):
            if not self.at(":", ""):
                self.expression()
        self.nl()

    def arguments(self) -> None:
        self.nl()
        while not self.at(""):
            if not self.attempt(lambda: (self.expression(), self.argument_end())):
                self.type_()
            self.take("...")
            self.nl()
            if not self.take(","):
                break
            self.nl()
        self.nl()

    def argument_end(self) -> None:
        if not self.at("", ",", "...", "\n"):
            raise Broken

    def elements(self) -> None:
        self.nl()
        while not self.at(""):
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                break
            self.nl()
        if self.t[self.p - 1] != "," and self.at("\n"):
            raise Broken
        self.nl()

    def element(self) -> None:
        if self.bracket() == "{":
            self.inner("{", "elements")
        else:
            self.expression()

    def unary(self, head: bool) -> None:
        while self.at("!", "-", "+", "^", "*", "&", "<-"):
            self.p += 1
        self.primary(head)

    def primary(self, head: bool) -> None:
        t, b = self.t[self.p], self.bracket()
        literal = False
        if t in ("0", "S"):
            self.p += 1
        elif t == "func":
            self.p += 1
            self.signature()
            if self.bracket() == "{":
                self.inner("{", "block")
        elif b == "(":
            if not self.attempt(lambda: self.inner("(", "expression_all")):
                self.inner("(", "type_all")
        elif b == "[" or t in ("map", "struct", "chan", "interface"):
            self.type_()
            literal = True
        elif t == "i":
            self.p += 1
            literal = not head
        else:
            raise Broken
        while True:
            b = self.bracket()
            if self.take("."):
                self.nl()
                if self.bracket() == "(":
                    if not self.attempt(lambda: self.inner("(", "type_all")):
                        self.inner("(", "type_switch")
                    literal = False
                else:
                    self.need("i")
            elif b == "(":
                self.inner("(", "arguments")
                literal = False
            elif b == "[":
                self.inner("[", "index")
            elif b == "{" and literal:
                self.inner("{", "elements")
                literal = False
            else:
                return

    def type_switch(self) -> None:
        self.need("type")
