"""A grammar of PostgreSQL scripts over folded shapes, with PL/pgSQL inside dollar quotes."""

from __future__ import annotations

import re

from quernstone.llm.grammar import Broken, Parser, fold

_LEX = re.compile(r"(?P<c>--[^\n]*|/\*[\s\S]*?\*/)|(?P<s>[eEbBxXnN]?'(?:[^']|'')*')|(?P<q>\"(?:[^\"]|\"\")+\")|(?P<d>\$(?P<tag>[A-Za-z_]\w*|)\$(?P<body>[\s\S]*?)\$(?P=tag)\$)")
_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)
# Words that don't serve as names, and words that shape statements.
_RESERVED = frozenset(
    "all analyse analyze and any array as asc asymmetric both case cast check collate column constraint create cross current_date current_role current_time current_timestamp current_user default deferrable desc distinct do else end except "
    "false fetch for foreign from full grant group having ilike in initially inner intersect into is isnull join lateral leading left like limit localtime localtimestamp natural not notnull null offset on only or order outer placing primary "
    "references returning right select session_user similar some symmetric table then to trailing true union unique user using variadic when where window with".split()
)
_STARTS = frozenset(
    "select with insert update delete create alter drop grant revoke comment begin commit rollback do set reset truncate copy analyze vacuum lock notify listen refresh savepoint release start end explain values call execute prepare deallocate declare fetch close reindex cluster security abort table show discard import reassign".split()
)
_WORD = re.compile(r"[^\W\d][\w$]*")
_TOKENS = re.compile(r"\x01|\x02|\x03\d+;|\$\d+|[A-Za-z_][\w$]*|[^\W\d_][\w$]*|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z_])|::|:=|=>|\.\.|<>|!=|<=|>=|\|\||->>|->|#>>|#>|@>|<@|\?\||\?&|~\*|!~\*|!~|[<>=+\-*/%^&|#~!?@]+|[^\s\w]|\d\w*")


class Sql(Parser):
    """Statements are split at semicolons after folding; tokens are lower-cased words and signs."""

    tokens = _TOKENS

    def check(self, text: str) -> bool:
        bodies: list[str] = []

        def one(m: re.Match) -> str:
            kind = m.lastgroup if m.lastgroup not in ("tag", "body") else "d"
            if kind == "c":
                return " "
            if kind == "s":
                return " \x01 "
            if kind == "q":
                return " \x02 "
            bodies.append(m["body"])
            return f" \x03{len(bodies) - 1}; "

        try:
            out = _LEX.sub(one, text)
            if _CONFLICT.search(out) or re.search(r"['\"`{}\\]|\$\$", out):
                return False
            low = re.sub(r"\s+", " ", out.lower()).strip()
            # Bodies are looked at on their own; statements recur without their numbers.
            numbered = self._plain(re.sub(r"\x03(\d+);", "\x03", low))
            try:
                s = fold(numbered, self.groups)
            except OverflowError:
                self.reset()
                s = fold(numbered, self.groups)
        except Broken:
            return False
        if re.search(r"[()\[\]]", s):
            return False
        parts = s.split(";")
        if parts[-1].strip() and not self.fits("statement", parts[-1].strip()):
            return False
        if not all(self.fits("statement", x.strip()) for x in parts if x.strip()):
            return False
        return all(self.body_ok(b) for b in bodies)

    @staticmethod
    def _plain(text: str) -> str:
        """Names of no meaning and numbers become one sign each, so that statements of a kind are parsed once."""
        return re.sub(r"\b\d+(?:\.\d+)?\b(?!\w)", "0", _WORD.sub(lambda m: m.group() if m.group() in _KEEP else "x", text)).strip()

    def body_ok(self, body: str) -> bool:
        """PL/pgSQL blocks and SQL bodies; other languages' bodies are strings to the server."""
        if _CONFLICT.search(body):
            return False
        out = _LEX.sub(lambda m: " " if m.lastgroup == "c" else " \x01 ", body)
        if re.search(r"['\"`{}\\]", out):
            return False
        low = re.sub(r"\s+", " ", out.lower()).strip()
        try:
            s = fold(low := self._plain(low), self.groups)
        except OverflowError:
            self.reset()
            s = fold(low, self.groups)
        if re.search(r"[()\[\]]", s):
            return False
        if re.match(r"(?:<< ?\w+ ?>> ?)?(?:declare|begin)\b", s):
            return self.fits("plpgsql", s)
        return all(self.fits("statement", x.strip()) for x in s.split(";") if x.strip()) if re.match(r"(?:select|with|insert|update|delete|values)\b", s) else bool(re.match(r"[\w\s]*$", s) is None or not s)

    # -- statements
    def word(self) -> bool:
        return bool(re.match(r"[^\W\d]", self.t[self.p]))

    def name(self) -> None:
        if self.take("\x02"):
            return
        if not self.word() or self.t[self.p] in _RESERVED:
            raise Broken
        self.p += 1

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            if not self.take("*"):
                self.any_word()

    def any_word(self) -> None:
        if self.take("\x02"):
            return
        if not self.word():
            raise Broken
        self.p += 1

    def opt(self, *words: str) -> bool:
        """All of these words in a row, or none."""
        if tuple(self.t[self.p : self.p + len(words)]) == words:
            self.p += len(words)
            return True
        return False

    def rest(self) -> None:
        """Whatever a clause may hold that this grammar doesn't know: words, literals, groups and signs, but no assignment."""
        while not self.at(""):
            if self.at(":=", "=>", "?", "@", "#", "!"):
                raise Broken
            self.p += 1

    def statement(self) -> None:
        t = self.t[self.p]
        if t in ("select", "values", "table") or t == "with" or self.bracket() == "(":
            self.query()
        elif t == "insert":
            self.insert()
        elif t == "update":
            self.update()
        elif t == "delete":
            self.delete()
        elif t == "create":
            self.create()
        elif t == "alter":
            self.alter()
        elif t == "do":
            self.p += 1
            self.opt("language", "x")
            if not self.take("\x03", "\x01"):
                raise Broken
            self.opt("language", "x")
        elif t == "set":
            self.p += 1
            self.take("local", "session")
            self.qualified() if not self.at("role", "time") else self.rest()
            if self.take("=", "to"):
                self.expression_list()
        elif t == "grant" or t == "revoke":
            self.p += 1
            some = False
            while not self.at("to", "from", ""):
                self.p += 1
                some = True
            if not some or not self.take("to", "from"):
                raise Broken
            self.rest()
        elif t in _STARTS:
            self.p += 1
            self.rest()
        else:
            raise Broken

    def query(self) -> None:
        if self.take("with"):
            self.take("recursive")
            while True:
                self.name()
                if self.bracket() == "(":
                    self.inner("(", "names")
                self.need("as")
                if self.opt("not", "materialized") or self.take("materialized"):
                    pass
                self.inner("(", "statement")
                if not self.take(","):
                    break
            if self.at("insert", "update", "delete"):
                return self.statement()
        self.select_part()
        while self.take("union", "intersect", "except"):
            self.take("all", "distinct")
            self.select_part()
        if self.opt("order", "by"):
            self.order_list()
        while self.take("limit", "offset", "fetch", "for"):
            while not self.at("", "limit", "offset", "fetch", "for"):
                self.p += 1
        return None

    def select_part(self) -> None:
        if self.bracket() == "(":
            return self.inner("(", "statement")
        if self.take("values"):
            self.inner("(", "expression_list")
            while self.take(","):
                self.inner("(", "expression_list")
            return None
        if self.take("table"):
            return self.qualified()
        self.need("select")
        if self.take("distinct"):
            if self.take("on"):
                self.inner("(", "expression_list")
        else:
            self.take("all")
        if not self.at("from", "", "into"):
            while True:
                self.target()
                if not self.take(","):
                    break
        if self.take("into"):
            self.take("strict")
            self.qualified()
            while self.take(","):
                self.qualified()
        if self.take("from"):
            self.from_item()
            while self.take(","):
                self.from_item()
        if self.take("where"):
            self.expression()
        if self.opt("group", "by"):
            self.expression_list()
        if self.take("having"):
            self.expression()
        if self.take("window"):
            self.name()
            self.need("as")
            self.p += 1
        return None

    def target(self) -> None:
        if self.take("*"):
            return
        self.expression()
        if self.take("as"):
            self.any_word()
        elif (self.word() and self.t[self.p] not in _RESERVED and not self.at("loop")) or self.at("\x02"):
            self.p += 1

    def from_item(self) -> None:
        self.table_item()
        while True:
            if self.opt("cross", "join") or self.opt("natural", "join"):
                self.table_item()
                continue
            p = self.p
            self.take("natural")
            if self.take("left", "right", "full"):
                self.take("outer")
            else:
                self.take("inner")
            if not self.take("join"):
                self.p = p
                return
            self.table_item()
            if self.take("on"):
                self.expression()
            elif self.take("using"):
                self.inner("(", "names")
            else:
                raise Broken

    def table_item(self) -> None:
        self.take("lateral")
        self.take("only")
        if self.bracket() == "(":
            self.inner("(", "statement", "from_item")
        else:
            self.qualified()
            if self.bracket() == "(":
                self.inner("(", "arguments")
        if self.opt("with", "ordinality"):
            pass
        if self.take("as"):
            self.any_word()
        elif (self.word() and self.t[self.p] not in _RESERVED and self.t[self.p] not in ("set", "returning", "window", "loop", "tablesample")) or self.at("\x02"):
            self.p += 1
        if self.bracket() == "(":
            self.p += 1
        if self.take("tablesample"):
            self.name()
            self.inner("(", "expression_list")

    def order_list(self) -> None:
        while True:
            self.expression()
            self.take("asc", "desc")
            if self.take("nulls"):
                self.need("first", "last")
            if not self.take(","):
                return

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def insert(self) -> None:
        self.need("insert")
        self.need("into")
        self.qualified()
        if self.take("as"):
            self.name()
        if self.bracket() == "(" and self.t[self.p + 1] not in ("",):
            self.inner("(", "column_names")
        if self.opt("overriding", "system", "value") or self.opt("overriding", "user", "value"):
            pass
        if not self.opt("default", "values"):
            self.query()
        if self.opt("on", "conflict"):
            if self.bracket() == "(":
                self.p += 1
                if self.take("where"):
                    self.expression()
            elif self.opt("on", "constraint"):
                self.name()
            self.need("do")
            if not self.take("nothing"):
                self.need("update")
                self.need("set")
                self.assignments()
                if self.take("where"):
                    self.expression()
        self.returning()

    def column_names(self) -> None:
        self.qualified()
        while self.take(","):
            self.qualified()

    def returning(self) -> None:
        if self.take("returning"):
            while True:
                self.target()
                if not self.take(","):
                    break
            if self.take("into"):
                self.take("strict")
                self.qualified()
                while self.take(","):
                    self.qualified()

    def update(self) -> None:
        self.need("update")
        self.take("only")
        self.qualified()
        if self.take("as"):
            self.name()
        elif not self.at("set"):
            self.name()
        self.need("set")
        self.assignments()
        if self.take("from"):
            self.from_item()
            while self.take(","):
                self.from_item()
        if self.take("where"):
            self.expression()
        self.returning()

    def assignments(self) -> None:
        while True:
            if self.bracket() == "(":
                self.inner("(", "column_names")
            else:
                self.qualified()
                if self.bracket() == "[":
                    self.inner("[", "expression")
            self.need("=")
            if not self.take("default"):
                self.expression()
            if not self.take(","):
                return

    def delete(self) -> None:
        self.need("delete")
        self.need("from")
        self.take("only")
        self.qualified()
        if self.take("as"):
            self.name()
        elif self.word() and self.t[self.p] not in _RESERVED:
            self.name()
        if self.take("using"):
            self.from_item()
        if self.take("where"):
            self.expression()
        self.returning()

    def create(self) -> None:
        self.need("create")
        self.opt("or", "replace")
        while self.take("temp", "temporary", "unlogged", "global", "local", "materialized", "recursive", "foreign"):
            pass
        if self.take("table"):
            self.opt("if", "not", "exists")
            self.qualified()
            if self.take("as"):
                return self.query()
            if self.bracket() == "(":
                self.inner("(", "table_elements", "names")
                if self.take("as"):
                    return self.query()
                return self.rest()
            if self.at("partition", "of", "inherits"):
                return self.rest()
            raise Broken
        if self.take("view"):
            self.opt("if", "not", "exists")
            self.qualified()
            if self.bracket() == "(":
                self.inner("(", "names")
            if self.take("with"):
                self.p += 1
            self.need("as")
            return self.query()
        unique = self.take("unique")
        if self.take("index"):
            self.take("concurrently")
            self.opt("if", "not", "exists")
            if not self.at("on"):
                self.name()
            self.need("on")
            self.take("only")
            self.qualified()
            if self.take("using"):
                self.name()
            self.inner("(", "index_columns")
            if self.take("include"):
                self.inner("(", "names")
            if self.opt("nulls", "not", "distinct") or self.opt("nulls", "distinct"):
                pass
            if self.take("with"):
                self.p += 1
            if self.take("where"):
                self.expression()
            return None
        if unique:
            raise Broken
        if self.take("function", "procedure"):
            self.qualified()
            self.inner("(", "function_parameters")
            body = False
            while not self.at(""):
                if self.take("returns"):
                    if self.take("table"):
                        self.inner("(", "function_parameters")
                    elif self.opt("null", "on", "null", "input"):
                        pass
                    else:
                        self.take("setof")
                        self.type_()
                elif self.take("language"):
                    if not self.take("\x01"):
                        self.any_word()
                elif self.take("as"):
                    self.need("\x03", "\x01")
                    body = True
                    if self.take(","):
                        self.need("\x01")
                elif self.take("set"):
                    self.qualified()
                    self.need("=", "to", "from")
                    self.expression_list()
                elif self.take("immutable", "stable", "volatile", "strict", "leakproof", "window"):
                    pass
                elif self.take("security"):
                    self.need("definer", "invoker")
                elif self.take("parallel"):
                    self.any_word()
                elif self.take("cost", "rows"):
                    self.p += 1
                elif self.opt("called", "on", "null", "input") or self.opt("not", "leakproof"):
                    pass
                elif self.take("return"):
                    self.expression()
                    body = True
                else:
                    raise Broken
            if not body:
                raise Broken
            return None
        if self.take("policy"):
            self.name()
            self.need("on")
            self.qualified()
            return self.rest()
        if self.take("trigger", "constraint"):
            self.take("trigger")
            self.name()
            if not (self.take("before", "after") or self.opt("instead", "of")):
                raise Broken
            while not self.at("on", ""):
                self.p += 1
            self.need("on")
            self.qualified()
            while not self.at("execute", ""):
                self.p += 1
            self.need("execute")
            self.need("function", "procedure")
            self.qualified()
            return self.inner("(", "arguments")
        if self.take("type"):
            self.qualified()
            if self.take("as"):
                self.take("enum", "range")
                if self.bracket() != "(":
                    raise Broken
                self.p += 1
            return None
        if self.take("role", "user", "group"):
            self.name()
            return self.rest()
        if self.take("schema", "extension", "sequence", "domain", "database", "publication", "subscription", "server", "aggregate", "operator", "cast", "rule", "event", "statistics", "collation", "text", "tablespace", "access", "conversion", "language", "trusted", "transform"):
            if self.at(""):
                raise Broken
            return self.rest()
        raise Broken

    def index_columns(self) -> None:
        while True:
            self.expression()
            if self.word() and self.t[self.p] not in ("asc", "desc", "nulls"):
                self.p += 1
            self.take("asc", "desc")
            if self.take("nulls"):
                self.need("first", "last")
            if not self.take(","):
                return

    def function_parameters(self) -> None:
        while not self.at(""):
            self.take("in", "out", "inout", "variadic")
            p = self.p
            if not self.attempt(lambda: (self.name(), self.take("in", "out", "inout"), self.type_(), self.parameter_end())):
                self.p = p
                self.type_()
                self.parameter_end()
            if not self.take(","):
                return

    def parameter_end(self) -> None:
        if self.take("default", "=", ":="):
            self.expression()
        if not self.at("", ","):
            raise Broken

    def table_elements(self) -> None:
        while True:
            if self.at("constraint", "primary", "unique", "foreign", "check", "exclude", "like"):
                if self.take("constraint"):
                    self.name()
                self.need("primary", "unique", "foreign", "check", "exclude", "like")
                while not self.at("", ","):
                    self.p += 1
            else:
                self.name()
                self.type_()
                self.column_constraints()
            if not self.take(","):
                return

    def column_constraints(self) -> None:
        while not self.at("", ","):
            if self.take("constraint"):
                self.name()
            elif self.opt("not", "null") or self.take("null") or self.opt("primary", "key") or self.take("unique"):
                pass
            elif self.take("default"):
                self.expression()
            elif self.take("check"):
                self.inner("(", "expression")
            elif self.take("references"):
                self.qualified()
                if self.bracket() == "(":
                    self.inner("(", "names")
                while self.take("on"):
                    self.need("delete", "update")
                    if not (self.take("cascade", "restrict") or self.opt("set", "null") or self.opt("set", "default") or self.opt("no", "action")):
                        raise Broken
            elif self.take("collate"):
                self.qualified()
            elif self.take("generated"):
                while not self.at("", ","):
                    self.p += 1
            elif self.take("deferrable", "initially", "deferred", "immediate"):
                pass
            else:
                raise Broken

    def type_(self) -> None:
        if self.opt("double", "precision") or self.opt("character", "varying") or self.opt("bit", "varying"):
            pass
        else:
            self.qualified()
        if self.take("%"):
            self.need("type", "rowtype")
        if self.bracket() == "(":
            self.inner("(", "expression_list")
        if self.at("with", "without") and self.t[self.p + 1] == "time":
            self.p += 3
        while self.bracket() == "[":
            self.inner("[", "maybe_number")
        if self.take("array"):
            pass

    def maybe_number(self) -> None:
        if not self.at(""):
            self.expression()

    def alter(self) -> None:
        self.need("alter")
        if self.take("table"):
            self.opt("if", "exists")
            self.take("only")
            self.qualified()
            while True:
                if self.take("add"):
                    self.take("column")
                    self.opt("if", "not", "exists")
                    if self.at("constraint", "primary", "unique", "foreign", "check"):
                        while not self.at("", ","):
                            self.p += 1
                    else:
                        self.name()
                        self.type_()
                        self.column_constraints()
                elif self.at("drop", "alter", "rename", "enable", "disable", "owner", "set", "validate", "attach", "detach", "force", "no", "inherit", "replica", "cluster", "reset"):
                    self.p += 1
                    some = False
                    while not self.at("", ","):
                        if self.at(":=", "=>"):
                            raise Broken
                        self.p += 1
                        some = True
                    if not some:
                        raise Broken
                else:
                    raise Broken
                if not self.take(","):
                    return
        if self.take("role", "user", "database", "function", "procedure", "type", "schema", "sequence", "index", "view", "materialized", "policy", "trigger", "extension", "domain", "default", "system", "publication", "group", "server"):
            if self.at(""):
                raise Broken
            self.p += 1
            if self.at(""):
                raise Broken
            return self.rest()
        raise Broken

    # -- expressions
    _OPERATORS = frozenset("= <> != < > <= >= + - * / % ^ || -> ->> #> #>> @> <@ && & | # ~ ~* !~ !~* ? ?| ?& << >> @@ <-> and or".split())

    def expression_list(self) -> None:
        while True:
            self.expression()
            if not self.take(","):
                return

    def arguments(self) -> None:
        if self.at(""):
            return
        if self.take("*"):
            return
        self.take("distinct", "all", "variadic")
        while True:
            if self.word() and self.t[self.p + 1] in ("=>", ":="):
                self.p += 2
            if self.at("select", "with"):
                self.query()
            else:
                self.expression()
            if self.take("from", "for", "in", "placing", "using", "separator"):
                self.expression()
                if self.take("for"):
                    self.expression()
            if self.opt("order", "by"):
                self.order_list()
            if not self.take(","):
                return

    def expression(self) -> None:
        self.operand()
        while True:
            t = self.t[self.p]
            if t in self._OPERATORS:
                self.p += 1
                if self.take("any", "all", "some"):
                    self.inner("(", "statement", "expression_list")
                else:
                    self.operand()
            elif t == "is":
                self.p += 1
                self.take("not")
                if self.opt("distinct", "from"):
                    self.operand()
                elif not self.take("null", "true", "false", "unknown", "document"):
                    raise Broken
            elif t in ("isnull", "notnull"):
                self.p += 1
            elif t in ("like", "ilike", "in", "between", "similar") or (t == "not" and self.t[self.p + 1] in ("like", "ilike", "in", "between", "similar")):
                self.take("not")
                if self.take("in"):
                    self.inner("(", "statement", "expression_list")
                elif self.take("between"):
                    self.take("symmetric")
                    self.operand()
                    self.need("and")
                    self.operand()
                elif self.take("like", "ilike") or self.opt("similar", "to"):
                    self.operand()
                    if self.take("escape"):
                        self.operand()
                else:
                    raise Broken
            elif t == "at" and self.t[self.p + 1] == "time":
                self.p += 3
                self.operand()
            elif t == "collate":
                self.p += 1
                self.qualified()
            else:
                return

    def operand(self) -> None:
        while self.take("not", "-", "+", "~", "@"):
            pass
        t, b = self.t[self.p], self.bracket()
        if t in ("0", "\x01", "\x03", "null", "true", "false", "default", "current_date", "current_timestamp", "current_user", "current_time", "localtimestamp", "session_user", "user", "current_role", "localtime") or re.match(r"\$\d|\d|\.\d", t):
            self.p += 1
        elif b == "(":
            self.inner("(", "statement", "expression_list")
        elif t == "case":
            self.p += 1
            if not self.at("when"):
                self.expression()
            some = False
            while self.take("when"):
                self.expression()
                self.need("then")
                self.expression()
                some = True
            if self.take("else"):
                self.expression()
            self.need("end")
            if not some:
                raise Broken
        elif t in ("exists", "array", "row", "any", "all", "some", "unique"):
            self.p += 1
            if self.bracket() == "[":
                self.inner("[", "maybe_list")
            else:
                self.inner("(", "statement", "arguments")
        elif t == "cast":
            self.p += 1
            self.inner("(", "cast")
        elif t in ("left", "right", "interval", "date", "timestamp", "timestamptz", "time"):
            self.p += 1
            if self.bracket() == "(":
                self.inner("(", "arguments")
            elif not self.take("\x01"):
                if t in ("left", "right"):
                    raise Broken
                while self.take("."):
                    self.any_word()
        else:
            self.qualified()
            if self.bracket() == "(":
                self.inner("(", "arguments")
                if self.take("filter"):
                    self.inner("(", "where_clause")
                if self.take("over"):
                    if self.bracket() == "(":
                        self.p += 1
                    else:
                        self.name()
            elif self.take("\x01"):
                pass
        while True:
            if self.take("::"):
                self.type_()
            elif self.bracket() == "[":
                self.inner("[", "subscript")
            elif self.at(".") and self.t[self.p - 1] not in ("0",):
                self.p += 1
                if not self.take("*"):
                    self.any_word()
            else:
                return

    def maybe_list(self) -> None:
        if not self.at(""):
            self.expression_list()

    def subscript(self) -> None:
        if not self.at(":"):
            self.expression()
        if self.take(":") and not self.at(""):
            self.expression()

    def where_clause(self) -> None:
        self.need("where")
        self.expression()

    def cast(self) -> None:
        self.expression()
        self.need("as")
        self.type_()

    # -- PL/pgSQL
    def plpgsql(self) -> None:
        self.block()
        self.take(";")

    def block(self) -> None:
        if self.take("declare"):
            while not self.at("begin", ""):
                self.name()
                if self.take("alias"):
                    self.need("for")
                    self.p += 1
                elif self.take("cursor"):
                    self.need("for")
                    self.query()
                else:
                    self.take("constant")
                    self.type_()
                    self.opt("not", "null")
                    if self.take(":=", "=", "default"):
                        self.expression()
                self.need(";")
        self.need("begin")
        self.body()
        if self.take("exception"):
            while self.take("when"):
                self.name()
                while self.take("or"):
                    self.name()
                self.need("then")
                self.body()
        self.need("end")
        if self.word() and not self.at("if", "loop", "case"):
            self.name()

    def body(self) -> None:
        while not self.at("end", "exception", "elsif", "elseif", "else", "when", ""):
            self.command()

    def command(self) -> None:
        t = self.t[self.p]
        if t == "if":
            self.p += 1
            self.expression()
            self.need("then")
            self.body()
            while self.take("elsif", "elseif"):
                self.expression()
                self.need("then")
                self.body()
            if self.take("else"):
                self.body()
            self.need("end")
            self.need("if")
            return self.need(";")
        if t in ("for", "while", "loop", "foreach"):
            self.p += 1
            if t == "for":
                self.qualified()
                while self.take(","):
                    self.qualified()
                self.need("in")
                self.take("reverse")
                if self.at("select", "with", "execute"):
                    if self.take("execute"):
                        self.expression()
                    else:
                        self.query()
                else:
                    self.expression()
                    if self.take(".."):
                        self.expression()
                    if self.take("by"):
                        self.expression()
                self.need("loop")
            elif t == "while":
                self.expression()
                self.need("loop")
            elif t == "foreach":
                self.qualified()
                self.need("in")
                self.need("array")
                self.expression()
                self.need("loop")
            self.body()
            self.need("end")
            self.need("loop")
            return self.need(";")
        if t == "case":
            self.p += 1
            if not self.at("when"):
                self.expression()
            while self.take("when"):
                self.expression_list()
                self.need("then")
                self.body()
            if self.take("else"):
                self.body()
            self.need("end")
            self.need("case")
            return self.need(";")
        if t in ("begin", "declare"):
            self.block()
            return self.need(";")
        if t == "return":
            self.p += 1
            if self.take("query"):
                if self.take("execute"):
                    self.expression()
                else:
                    self.query()
            elif self.take("next"):
                if not self.at(";"):
                    self.expression()
            elif not self.at(";"):
                self.expression()
            return self.need(";")
        if t == "raise":
            self.p += 1
            self.take("notice", "exception", "warning", "info", "log", "debug")
            if self.take("\x01"):
                while self.take(","):
                    self.expression()
            elif self.word() and not self.at("using"):
                self.name()
            if self.take("using"):
                while True:
                    self.name()
                    self.need("=", ":=")
                    self.expression()
                    if not self.take(","):
                        break
            return self.need(";")
        if t in ("exit", "continue"):
            self.p += 1
            if self.word() and not self.at("when"):
                self.name()
            if self.take("when"):
                self.expression()
            return self.need(";")
        if t in ("perform",):
            self.t[self.p] = "select"
            self.query()
            return self.need(";")
        if t == "execute":
            self.p += 1
            self.expression()
            while self.take("into", "using"):
                self.take("strict")
                self.expression_list()
            return self.need(";")
        if t == "null":
            self.p += 1
            return self.need(";")
        if t in ("open", "close", "fetch", "move", "get", "assert", "call", "commit", "rollback", "alter", "drop", "create", "grant", "revoke", "truncate", "lock", "set", "analyze", "refresh", "comment", "notify", "copy"):
            while not self.at(";", ""):
                self.p += 1
            return self.need(";")
        if t in ("select", "with", "insert", "update", "delete"):
            self.statement()
            return self.need(";")
        self.qualified()
        if self.bracket() == "[":
            self.inner("[", "expression")
        self.need(":=", "=")
        self.expression()
        return self.need(";")


# Words that the grammar tells apart.
_KEEP = frozenset(re.findall(r"[a-z_]{2,}", " ".join(_RESERVED | _STARTS))) | frozenset(
    "abort access action add after aggregate alias always assert at before between by called cascade cast close collation column commit concurrently conflict constant continue conversion cost cursor database deferred definer depends detach "
    "disable domain double each elseif elsif enable enum escape event exception exclude execute exists exit extension filter first following force foreach function generated get global group identity if immediate immutable include index info "
    "inherit inherits inout input insert instead interval invoker key language last leakproof local log loop match materialized move multiplying name next no nothing notice nothing notify nulls of oids open operator option out over overriding owner "
    "parallel partition perform policy preceding precision prepare procedure publication query raise range recursive refresh rename replace replica reset restrict return returns reverse role rollback row rows rowtype rule safe schema security "
    "sequence server session set setof stable start statement statistics stored strict subscription system tablesample tablespace temp temporary text time timestamp timestamptz date transaction transform trigger trusted type unknown unlogged until "
    "update validate value values varying view volatile warning when while within without work zone ordinality debug insert delete merge".split()
)
