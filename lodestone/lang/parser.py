"""Text to syntax tree: precedence climbing for expressions, recursive descent for statements."""

from __future__ import annotations

from lodestone.lang import tree as t
from lodestone.lang.lexer import SyntaxProblem, Token, tokens

#: Binding strength of infix operators, loosest first.
_INFIX = {
    "OR": 5, "AND": 6, "=": 8, "<>": 8, "!=": 8, "<": 9, "<=": 9, ">": 9, ">=": 9, "IN": 9, "SIMILAR": 9, "IS": 9, "BETWEEN": 9, "NOT": 9,
    "&": 10, "|": 10, "^": 10, "<<": 10, ">>": 10, ">>>": 10, "||": 11, "+": 12, "-": 12, "*": 15, "/": 15, "%": 15,
}
_NOT, _UNARY, _POSTFIX = 7, 17, 32
_QUANTIFIERS = ("ALL", "ANY", "SOME")
_END_WORDS = {
    "FROM", "WHERE", "GROUP", "ORDER", "HAVING", "UNION", "EXCEPT", "INTERSECT", "MATCH", "AGAINST", "ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "OUTER", "FULL", "CROSS",
    "AS", "ASC", "DESC", "NULLS", "AND", "OR", "NOT", "IN", "IS", "BETWEEN", "SIMILAR", "WHEN", "THEN", "ELSE", "END", "SET", "ADD", "DELETE", "RENAME", "MOVE", "VALUES", "SELECT", "BEFORE", "AFTER", "TO",
}
_ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "||=")
_META = {"FT_INDEX", "SEPARATE_STORAGE", "INMEM", "INDEXED", "SYNC", "ASYNC", "ENTER", "UPDATE", "LEAVE"}
_KIND_WORDS = ("CLASS", "EVENT", "TIMER", "LISTENER", "LOADER", "ENUMERATION", "CONDITION", "ACTION", "COMMUNICATION", "PIPELINE", "HANDLER", "FSM", "PACKAGE", "STORE")


def parse(text: str) -> list[t.Node]:
    """All statements of a script."""
    return Parser(text).script()


def parse_expression(text: str) -> t.Node:
    p = Parser(text)
    x = p.expression()
    p.expect_end()
    return x


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokens(text), 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        x = self.now
        self.i += 1
        return x

    def is_word(self, *words: str, at: int = 0) -> bool:
        x = self.ahead(at)
        return x.kind == "word" and x.upper in words

    def is_op(self, *ops: str, at: int = 0) -> bool:
        x = self.ahead(at)
        return x.kind == "op" and x.value in ops

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.i += 1
            return True
        return False

    def op(self, *ops: str) -> bool:
        if self.is_op(*ops):
            self.i += 1
            return True
        return False

    def fail(self, wanted: str) -> SyntaxProblem:
        return SyntaxProblem(f"expected {wanted} at {self.now.at}, found {self.text[self.now.at : self.now.at + 20]!r}")

    def need_word(self, *words: str) -> str:
        if not self.is_word(*words):
            raise self.fail(" or ".join(words))
        return self.next().upper

    def need_op(self, *ops: str) -> str:
        if not self.is_op(*ops):
            raise self.fail(" or ".join(ops))
        return self.next().value

    def expect_end(self) -> None:
        if self.now.kind != "end":
            raise self.fail("the end")

    def name(self) -> str:
        if self.now.kind in ("word", "name", "object"):
            return self.next().value
        raise self.fail("a name")

    # -- statements

    def script(self) -> list[t.Node]:
        out = []
        while self.now.kind != "end":
            if self.op(";"):
                continue
            out.append(self.statement())
            if self.now.kind != "end":
                self.need_op(";")
        return out

    def statement(self) -> t.Node:
        if self.word("WITH"):
            values = []
            while True:
                if self.now.kind == "param":
                    key = str(self.next().value)
                else:
                    key = self.name()
                self.need_op("=")
                values.append((key, self.expression()))
                if not self.op(","):
                    break
            return t.With(values, self.statement())
        if self.is_word("SELECT") or self.is_op("("):
            return self.query()
        if self.is_word("INSERT"):
            return self.insert()
        if self.is_word("UPDATE"):
            return self.update()
        if self.is_word("DELETE", "PURGE", "UNDELETE"):
            return self.delete()
        if self.is_word("CREATE"):
            return self.create()
        if self.word("DROP"):
            kind = self.need_word(*_KIND_WORDS)
            if kind == "EVENT" and self.word("HANDLER"):
                kind = "HANDLER"
            return t.Drop(kind, self.name())
        if self.word("START"):
            if not self.word("TRANSACTION"):
                return t.Setting("START", self.name(), None)
            only = False
            if self.word("READ"):
                only = self.need_word("ONLY", "WRITE") == "ONLY"
            return t.Transaction("START", read_only=only)
        if self.is_word("COMMIT", "ROLLBACK"):
            kind = self.next().upper
            return t.Transaction(kind, all=self.word("ALL"))
        if self.word("SET"):
            return self.setting()
        if self.word("RULE"):
            return self.rule()
        if self.word("OPEN", "CLOSE"):
            kind = self.tokens[self.i - 1].upper
            self.need_word("STORE")
            return t.Setting(kind, None, self.expression() if self.now.kind != "end" and not self.is_op(";") else None)
        raise self.fail("a statement")

    def setting(self) -> t.Setting:
        what = self.need_word("BASE", "PREFIX", "TRACE", "ISOLATION")
        if what == "BASE":
            return t.Setting(what, None, self.next().value)
        if what == "PREFIX":
            x = self.next()
            key = x.extra if x.kind == "name" and x.extra else x.value
            if x.kind == "name" and x.extra:
                return t.Setting(what, str(key), x.value)
            self.op(":")
            return t.Setting(what, str(key), self.next().value)
        if what == "TRACE":
            on, options = True, []
            while self.now.kind == "word":
                w = self.next().upper
                if w in ("ON", "OFF"):
                    on = w == "ON"
                else:
                    options.append(w)
                self.op(",")
            return t.Setting(what, ",".join(options) or "ALL", on)
        words = []
        while self.now.kind == "word":
            words.append(self.next().upper)
        return t.Setting(what, None, " ".join(words))

    def rule(self) -> t.Rule:
        name = self.name()
        self.need_op(":")
        parts: tuple[list, list] = ([], [])
        side = 0
        while True:
            what, args = self.name(), []
            if self.op("("):
                while not self.op(")"):
                    args.append(self.expression())
                    self.op(",")
            parts[side].append((what, args))
            if not side and self.word("AND"):
                continue
            if not side:
                self.need_op("->")
                side = 1
                continue
            if not self.op(","):
                break
        return t.Rule(name, *parts)

    # -- queries

    def query(self) -> t.Node:
        left = self.query_term()
        while self.is_word("UNION", "EXCEPT"):
            op = self.next().upper
            every = self.word("ALL")
            if not every:
                self.word("DISTINCT")
            left = t.SetOp(op, every, left, self.query_term())
        if self.word("ORDER"):
            self.need_word("BY")
            left.order = self.order_list()
        return left

    def query_term(self) -> t.Node:
        """INTERSECT binds tighter than the others."""
        left = self.query_factor()
        while self.word("INTERSECT"):
            every = self.word("ALL")
            if not every:
                self.word("DISTINCT")
            left = t.SetOp("INTERSECT", every, left, self.query_factor())
        return left

    def query_factor(self) -> t.Node:
        if self.op("("):
            q = self.query()
            self.need_op(")")
            return q
        return self.select()

    def select(self) -> t.Select:
        self.need_word("SELECT")
        out = t.Select(None)
        while self.is_word("ALL", "DISTINCT", "RAW", "FIRST"):
            out.modes.add(self.next().upper)
        star = self.is_op("*") and not self.is_op("(", at=1)
        if star:
            self.next()
        elif not self.is_word("FROM", "WHERE", "MATCH", "GROUP", "ORDER") and self.now.kind != "end" and not self.is_op(")", ";"):
            out.items = [self.item()]
            while self.op(","):
                out.items.append(self.item())
        if self.word("FROM"):
            out.source = self.sources()
        while self.is_word("WHERE", "MATCH"):
            if self.word("WHERE"):
                c = self.expression()
                out.where = c if out.where is None else t.Binary("AND", out.where, c)
            else:
                out.match.append(self.match())
        if self.word("GROUP"):
            self.need_word("BY")
            out.group = self.order_list()
            if self.word("HAVING"):
                out.having = self.expression()
        elif self.word("HAVING"):
            out.having = self.expression()
        if not star and out.items is None and not out.group:
            raise self.fail("what to select")
        return out

    def item(self) -> t.Item:
        if self.is_op("@", "*") and not self.is_word("AS", at=1):
            self.next()
            return t.Item(t.Self("row"))
        x = self.expression()
        alias = None
        if self.word("AS"):
            alias = self.name()
        elif self.now.kind == "name" or self.now.kind == "word" and self.now.upper not in _END_WORDS:
            alias = self.name()
        return t.Item(x, alias)

    def match(self) -> t.Match:
        self.need_word("MATCH")
        props, words = [], []
        if self.op("("):
            while not self.op(")"):
                props.append(self.name())
                self.op(",")
        self.need_word("AGAINST")
        self.need_op("(")
        words.append(self.expression())
        while self.op(","):
            words.append(self.expression())
        self.need_op(")")
        return t.Match(props, words)

    def order_list(self) -> list[t.Order]:
        out = []
        while True:
            o = t.Order(self.expression())
            if self.word("DESC"):
                o.desc = True
            else:
                self.word("ASC")
            if self.word("NULLS"):
                o.nulls = self.need_word("FIRST", "LAST")
            out.append(o)
            if not self.op(","):
                return out

    def sources(self) -> t.Node:
        left = self.source_or_group()
        while True:
            if self.op(","):
                kind = "CROSS"
            elif self.word("JOIN"):
                kind = "INNER"
            elif self.is_word("INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "SEMI", "ANTI"):
                first = self.next().upper
                kind = "FULL" if first == "OUTER" else first
                if self.word("SEMI", "ANTI"):
                    kind = self.tokens[self.i - 1].upper
                if first != "OUTER":
                    self.word("OUTER")
                self.need_word("JOIN")
            else:
                return left
            right = self.source_or_group()
            j = t.Join(kind, left, right)
            if self.word("ON"):
                j.on = self.expression()
            elif self.word("USING"):
                self.need_op("(")
                j.using = [self.name()]
                while self.op(","):
                    j.using.append(self.name())
                self.need_op(")")
            left = j

    def source_or_group(self) -> t.Node:
        if self.is_op("(") and not self.is_word("SELECT", at=1) and not self.is_op("(", at=1):
            mark = self.i
            self.next()
            try:
                inner = self.sources()
                self.need_op(")")
                if isinstance(inner, t.Join):
                    return inner
            except SyntaxProblem:
                pass
            self.i = mark
        return self.source()

    def source(self) -> t.Source:
        out = t.Source(None)
        if self.op("*"):
            out.what = "*"
        elif self.is_op("(") and (self.is_word("SELECT", at=1) or self.is_op("(", at=1)):
            self.next()
            out.what = t.Sub(self.query())
            self.need_op(")")
        elif self.now.kind == "object":
            out.what = t.Object(self.next().value)
            out.path = self.steps()
        elif self.now.kind in ("word", "name"):
            out.what = [self.class_ref()]
            while self.op("&"):
                out.what.append(self.class_ref())
            if self.is_op("{"):
                self.next()
                out.ids = [self.expression()]
                while self.op(","):
                    out.ids.append(self.expression())
                self.need_op("}")
            out.path = self.steps()
        elif self.now.kind == "pid":
            out.what = self.primary()
            out.path = self.steps()
        else:
            out.what = self.primary()
        if self.word("AS"):
            out.alias = self.name()
        elif self.now.kind == "name" or self.now.kind == "word" and self.now.upper not in _END_WORDS and not self.is_word("SEMI", "ANTI"):
            out.alias = self.name()
        return out

    def class_ref(self) -> t.ClassRef:
        out = t.ClassRef(self.name())
        if self.op("("):
            while not self.op(")"):
                if self.op("*"):
                    out.args.append(None)
                else:
                    out.args.append(self.expression())
                self.op(",")
        return out

    def steps(self) -> list[t.Step]:
        out = []
        while self.op("."):
            if self.op("{"):
                s = t.Step([self.name()])
                while self.op(","):
                    s.props.append(self.name())
                self.need_op("}")
            elif self.op("*"):
                s = t.Step(["*"])
            else:
                s = t.Step([self.name()])
            repeated = self.repetition(s)
            if self.op("["):
                if self.now.kind == "param" and str(self.now.value).upper() in ("FIRST", "LAST"):
                    s.element = str(self.next().value).upper()
                else:
                    x = self.expression()
                    if isinstance(x, t.Lit) and x.kind == "int":
                        s.element = x
                    else:
                        s.where, s.last = x, repeated
                self.need_op("]")
            if not repeated:
                self.repetition(s)
            out.append(s)
        return out

    def repetition(self, s: t.Step) -> bool:
        """``{?}``, ``{+}``, ``{*}``, ``{n}``, ``{m, n}``, ``{*, n}`` or ``{m, *}``."""
        if not (self.is_op("{") and (self.ahead().kind == "number" or self.is_op("?", "+", "*", at=1))):
            return False
        self.next()
        if self.op("?"):
            s.low, s.high = 0, 1
        elif self.op("+"):
            s.low, s.high = 1, None
        elif self.op("*"):
            s.low, s.high = 0, self.next().value if self.op(",") else None
        else:
            s.low = s.high = self.next().value
            if self.op(","):
                s.high = None if self.op("*") else self.next().value
        self.need_op("}")
        return True

    # -- expressions

    def expression(self, least: int = 0) -> t.Node:
        left = self.prefix()
        while True:
            x = self.now
            key = x.upper if x.kind == "word" else x.value if x.kind == "op" else None
            if key == "NOT" and not self.is_word("IN", "BETWEEN", "SIMILAR", at=1):
                return left
            power = _INFIX.get(key)
            if power is None or power <= least:
                return left
            self.next()
            left = self.infix(key, left, power)

    def infix(self, key: str, left: t.Node, power: int) -> t.Node:
        negated = False
        if key == "NOT":
            negated, key = True, self.next().upper
        if key == "IN":
            return t.In(left, self.expression(power), negated)
        if key == "BETWEEN":
            low = self.expression(9)
            self.need_word("AND")
            return t.Between(left, low, self.expression(9), negated)
        if key == "SIMILAR":
            self.word("TO")
            return t.Similar(left, self.expression(power), negated)
        if key == "IS":
            negated = self.word("NOT")
            if self.word("A") or self.word("AN"):
                refs = [self.class_ref()]
                while self.op("&"):
                    refs.append(self.class_ref())
                return t.IsA(left, [(r.name, r.args) for r in refs], negated)
            return t.Is(left, self.need_word("NULL", "TRUE", "FALSE"), negated)
        if key in ("=", "<>", "!=", "<", "<=", ">", ">=") and self.is_word(*_QUANTIFIERS) and self.is_op("(", "{", at=1) | (self.ahead().kind in ("word", "name", "param")):
            q = self.next().upper
            return t.Binary("<>" if key == "!=" else key, left, self.expression(power), "ANY" if q == "SOME" else q)
        return t.Binary("<>" if key == "!=" else key, left, self.expression(power))

    def prefix(self) -> t.Node:
        if self.word("NOT"):
            return t.Unary("NOT", self.expression(_NOT))
        if self.op("-"):
            x = self.expression(_UNARY)
            if isinstance(x, t.Lit) and x.kind in ("int", "float"):
                return t.Lit(-x.value, x.kind, x.unit)
            return t.Unary("-", x)
        if self.op("+"):
            return self.expression(_UNARY)
        if self.op("~"):
            return t.Unary("~", self.expression(_UNARY))
        if self.op("&"):
            return t.Unary("&", self.expression(30))
        if self.is_op("/") and self.ahead().kind == "number":
            self.next()
            return t.Capture(self.next().value)
        return self.postfix(self.primary())

    def postfix(self, x: t.Node) -> t.Node:
        while True:
            if self.is_op("["):
                self.next()
                special, index = None, []
                if self.now.kind == "param" and isinstance(self.now.value, str):
                    special = self.next().value.upper()
                else:
                    index.append(self.expression())
                    while self.op(","):
                        index.append(self.expression())
                self.need_op("]")
                x = t.Element(x, index, special)
            elif self.is_op(".") and isinstance(x, t.Name) and self.ahead().kind in ("word", "name") and not self.is_op("(", at=2):
                self.next()
                x.parts.append(self.name())
            elif self.is_op(".") and not isinstance(x, (t.Lit,)) or self.is_op(".") and isinstance(x, t.Lit) and x.kind == "pid":
                x = t.PathOf(x, self.steps())
            else:
                return x

    def primary(self) -> t.Node:
        x = self.now
        if x.kind == "number":
            self.next()
            return t.Lit(x.value, "int" if isinstance(x.value, int) else "float", x.extra)
        if x.kind == "string":
            self.next()
            s = x.value
            while self.now.kind == "string":  # neighbours are one text
                s += self.next().value
            return t.Lit(s, "string")
        if x.kind == "hex":
            self.next()
            return t.Lit(x.value, "binary")
        if x.kind == "pid":
            self.next()
            return t.Lit(x.value, "pid", None if x.extra is None else f"{x.extra:x}")
        if x.kind == "self":
            self.next()
            return t.Self(x.value)
        if x.kind == "object":
            self.next()
            return t.Object(x.value)
        if x.kind == "regex":
            self.next()
            return t.Regex(x.value, x.extra or "")
        if x.kind == "param":
            return self.param()
        if x.kind == "op":
            return self.bracket()
        if x.kind == "name":
            self.next()
            return t.Name([x.value], x.extra)
        if x.kind == "word":
            return self.named()
        raise self.fail("an expression")

    def param(self) -> t.Param:
        p = t.Param(self.next().value)
        if isinstance(p.key, int) and self.is_op("(") and self.ahead().kind == "word" and self.ahead(2).kind == "op" and self.ahead(2).value in (",", ")"):
            self.next()
            p.kind = self.next().upper
            while self.op(","):
                if self.word("NULLS"):
                    p.nulls = self.need_word("FIRST", "LAST")
                else:
                    p.order = self.need_word("ASC", "DESC")
            self.need_op(")")
        return p

    def bracket(self) -> t.Node:
        if self.op("("):
            if self.is_word("SELECT"):
                q = self.query()
                self.need_op(")")
                return t.Sub(q)
            if self.is_word("INSERT"):
                s = self.insert()
                self.need_op(")")
                return t.Sub(s)
            items = [self.expression()]
            while self.op(","):
                items.append(self.expression())
            self.need_op(")")
            return items[0] if len(items) == 1 else t.Coll(items)
        if self.op("@{"):
            fields = self.fields()
            return t.Struct(fields, pin=True)
        if self.op("@:"):
            n = self.next().value
            if self.op("@{"):
                return t.Struct(self.fields(), pin=True, temp=n)
            return t.Lit(n, "temp")
        if self.op("@["):
            low = None if self.op("*") else self.expression()
            self.need_op(",")
            high = None if self.op("*") else self.expression()
            self.need_op("]", ")")
            return t.Range(low, high)
        if self.op("["):
            items = []
            while not self.op("]"):
                items.append(self.expression())
                self.op(",")
            return t.ArrayOf(items)
        if self.op("{"):
            return self.braces()
        if self.is_op("$(", "${"):
            code = self.next().value == "${"
            start = self.now.at
            if code:
                body = [self.statement()]
                while self.op(";"):
                    if not self.is_op("}"):
                        body.append(self.statement())
            else:
                body = self.expression()
            end = self.now.at
            self.need_op("}" if code else ")")
            return t.Stored(self.text[start:end].strip(), body, code)
        if self.op("@"):
            return t.Self("row")
        if self.op("*"):
            return t.Self("row")
        raise self.fail("an expression")

    def fields(self) -> list[tuple[str, t.Node]]:
        out = []
        while not self.op("}"):
            key = self.name()
            self.meta()
            self.need_op("=")
            out.append((key, self.expression()))
            self.op(",")
        return out

    def meta(self) -> list[str]:
        out = []
        if self.is_op("(") and self.ahead().kind == "word" and self.ahead().upper in _META:
            self.next()
            while not self.op(")"):
                out.append(self.next().upper)
                self.op(",")
        return out

    def braces(self) -> t.Node:
        if self.op("}"):
            return t.Coll([])
        if self.now.kind in ("word", "name") and self.is_op("=", at=1):
            return t.Struct(self.fields())
        first = self.expression()
        if self.op("->"):
            pairs = [(first, self.expression())]
            while self.op(","):
                key = self.expression()
                self.need_op("->")
                pairs.append((key, self.expression()))
            self.need_op("}")
            return t.MapOf(pairs)
        items = [first]
        while self.op(","):
            items.append(self.expression())
        self.need_op("}")
        return t.Coll(items)

    def named(self) -> t.Node:
        x = self.next()
        up = x.upper
        if up == "NULL":
            return t.Lit(None, "null")
        if up in ("TRUE", "FALSE"):
            return t.Lit(up == "TRUE", "bool")
        if up in ("TIMESTAMP", "INTERVAL") and self.now.kind == "string":
            return t.Lit(self.next().value, up.lower())
        if up in ("CURRENT_TIMESTAMP", "CURRENT_USER", "CURRENT_STORE"):
            if self.op("("):
                self.need_op(")")
            return t.Call(up, [])
        if up == "CASE":
            return self.case()
        if up == "EXISTS" and self.op("("):
            what = t.Sub(self.query()) if self.is_word("SELECT") else self.expression()
            self.need_op(")")
            return t.Exists(what)
        if not self.is_op("("):
            return t.Name([x.value])
        self.next()
        if up == "CAST":
            inner = self.expression()
            self.need_word("AS")
            kind = str(self.next().value)
            while self.is_op(".", "/"):
                kind += self.next().value + str(self.next().value)
            self.need_op(")")
            return t.Cast(inner, kind)
        if up == "EXTRACT":
            part = self.next().upper
            self.need_word("FROM")
            inner = self.expression()
            self.need_op(")")
            return t.Extract(part, inner)
        if up == "TRIM":
            side = self.next().upper if self.is_word("LEADING", "TRAILING", "BOTH") else "BOTH"
            what = None if self.is_word("FROM") else self.expression()
            if self.word("FROM"):
                inner = self.expression()
            else:
                what, inner = None, what
            self.need_op(")")
            return t.Trim(side, what, inner)
        call = t.Call(up if up in _UPPER_CALLS else x.value, [])
        if up == "COUNT" and self.op("*"):
            self.need_op(")")
            call.star = True
            return call
        if self.word("DISTINCT"):
            call.distinct = True
        else:
            self.word("ALL")
        while not self.op(")"):
            call.args.append(t.Sub(self.query()) if self.is_word("SELECT") else self.expression())
            if not self.is_op(")"):
                self.need_op(",")
        return call

    def case(self) -> t.Case:
        subject = None if self.is_word("WHEN") else self.expression()
        whens, other = [], None
        while self.word("WHEN"):
            c = self.expression()
            self.need_word("THEN")
            whens.append((c, self.expression()))
        if self.word("ELSE"):
            other = self.expression()
        self.need_word("END")
        return t.Case(subject, whens, other)

    # -- changes

    def insert(self) -> t.Insert:
        self.need_word("INSERT")
        out = t.Insert(part=self.word("PART"))
        if self.word("INTO"):
            while True:
                cls = self.name()
                mode = self.next().upper if self.is_word("UNIQUE", "IDEMPOTENT") else None
                out.into.append((cls, mode))
                if not self.op(","):
                    break
        if self.word("OPTIONS"):
            self.need_op("(")
            while not self.op(")"):
                out.options.append(self.next().upper)
                self.op(",")
        if self.is_word("SELECT") or self.is_op("(") and self.is_word("SELECT", at=1):
            out.query = self.query()
            return out
        if self.now.kind == "self":
            self.next()
            out.copy_self = True
            self.op(",")
        if self.is_op("@{", "@:"):
            while True:
                s = self.bracket()
                if not isinstance(s, t.Struct):
                    raise self.fail("a row in braces")
                out.rows.append(s)
                if not self.op(","):
                    break
        elif self.op("("):
            props = [self.name()]
            while self.op(","):
                props.append(self.name())
            self.need_op(")")
            self.need_word("VALUES")
            while True:
                self.need_op("(")
                values = [self.expression()]
                while self.op(","):
                    values.append(self.expression())
                self.need_op(")")
                if len(values) != len(props):
                    raise SyntaxProblem(f"{len(props)} properties but {len(values)} values")
                out.rows.append(t.Struct(list(zip(props, values, strict=True)), pin=True))
                if not self.op(","):
                    break
        elif self.now.kind in ("word", "name") and not self.is_word("SELECT"):
            fields = []
            while True:
                key = self.name()
                self.meta()
                self.need_op("=")
                fields.append((key, self.expression()))
                if not self.op(","):
                    break
            out.rows.append(t.Struct(fields, pin=True))
        if self.is_word("SELECT"):
            out.query = self.query()
        return out

    def update(self) -> t.Update:
        self.need_word("UPDATE")
        raw = self.word("RAW")
        out = t.Update(self.source(), [], raw=raw)
        kind = None
        while True:
            if self.is_word("SET", "ADD", "DELETE", "RENAME", "MOVE"):
                kind = self.next().upper
            elif not self.op(","):
                break
            if self.is_word("SET", "ADD", "DELETE", "RENAME", "MOVE"):
                kind = self.next().upper
            prop, element, before = self.name(), None, False
            if self.op("["):
                before = self.word("BEFORE")
                if self.now.kind == "param" and isinstance(self.now.value, str):
                    element = self.next().value.upper()
                else:
                    element = self.expression()
                self.need_op("]")
            if kind == "SET":
                if not self.is_op(*_ASSIGN):
                    raise self.fail("an assignment")
                op = self.next().value
                out.changes.append(t.Change(op if op == "=" else op[:-1], prop, self.expression(), element))
            elif kind == "ADD":
                self.meta()
                self.need_op("=")
                out.changes.append(t.Change("ADD BEFORE" if before else "ADD", prop, self.expression(), element))
            elif kind == "DELETE":
                out.changes.append(t.Change("DELETE", prop, None, element))
            elif kind == "RENAME":
                if not self.op("="):
                    self.need_word("AS", "TO")
                out.changes.append(t.Change("RENAME", prop, t.Name([self.name()])))
            else:
                where = self.need_word("BEFORE", "AFTER")
                out.changes.append(t.Change(f"MOVE {where}", prop, self.expression(), element))
        if self.word("WHERE"):
            out.where = self.expression()
        return out

    def delete(self) -> t.Delete:
        kind = self.next().upper
        if self.now.kind == "pid" or self.is_op("{"):
            ids = []
            braces = self.op("{")
            ids.append(self.primary())
            while self.op(","):
                ids.append(self.primary())
            if braces:
                self.need_op("}")
            return t.Delete(kind, t.Source("*", ids=ids))
        out = t.Delete(kind, t.Source("*"))
        if self.word("FROM"):
            out.source = self.source()
        while self.is_word("WHERE", "MATCH"):
            if self.word("WHERE"):
                out.where = self.expression()
            else:
                out.match.append(self.match())
        return out

    # -- definitions

    def create(self) -> t.Create:
        self.need_word("CREATE")
        optional = self.word("OPTIONAL")
        kind = self.need_word(*_KIND_WORDS)
        if kind == "EVENT" and self.word("HANDLER"):
            kind = "HANDLER"
        if kind == "COMMUNICATION":
            self.word("PIPELINE")
        out = t.Create(kind, None)
        if optional:
            out.extra["optional"] = True
        if self.now.kind in ("object", "name") or self.now.kind == "word" and not self.is_word("AS", "ON", "INTERVAL"):
            out.name = self.name()
        if kind == "TIMER":
            out.extra["interval"] = self.primary()
        if kind == "LISTENER" and self.word("ON"):
            out.extra["on"] = self.expression()
        if kind == "PACKAGE" or kind == "STORE":
            if self.word("AS", "OPTIONS"):
                out.body = self.expression()
            return self.properties(out)
        self.need_word("AS")
        if kind in ("CLASS", "EVENT"):
            out.body = self.query()
        elif kind in ("TIMER", "ACTION"):
            out.body = self.actions()
        elif kind == "ENUMERATION":
            self.need_op("{")
            out.body = [self.next().value]
            while self.op(","):
                out.body.append(self.next().value)
            self.need_op("}")
        elif kind == "HANDLER":
            out.body = self.whens()
        elif kind == "FSM":
            self.need_op("{")
            out.body = {}
            while not self.op("}"):
                state = self.name()
                self.need_op(":")
                self.need_op("{")
                body: dict = {}
                while not self.op("}"):
                    key = self.name()
                    self.need_op("=")
                    body[key] = self.whens() if self.is_op("{") and self.is_word("WHEN", at=1) else self.expression()
                    self.op(",")
                out.body[state] = body
                self.op(",")
        else:
            out.body = self.expression()
        return self.properties(out)

    def properties(self, out: t.Create) -> t.Create:
        if self.word("SET"):
            while True:
                key = self.name()
                self.need_op("=")
                out.props.append((key, self.expression()))
                if not self.op(","):
                    break
        return out

    def actions(self) -> list[t.Node]:
        if self.is_op("${"):
            return self.bracket().body
        if self.op("{"):
            body = []
            while not self.op("}"):
                body.append(self.statement())
                self.op(";", ",")
            return body
        return [self.statement()]

    def whens(self) -> list[dict]:
        """``{WHEN what IS INSERTED AND condition -> {actions} -> state, ...}``"""
        out = []
        self.need_op("{")
        while not self.op("}"):
            self.need_word("WHEN")
            w: dict = {"what": None, "kinds": [], "interval": None, "and": None, "actions": [], "next": None}
            if self.is_word("INTERVAL"):
                w["interval"] = self.primary()
                self.need_word("EXPIRES")
            else:
                w["what"] = self.name() if not self.is_op("*") else self.next().value
                while self.op("."):
                    w["what"] += "." + self.name()
                self.word("IS")
                while self.is_word("INSERTED", "UPDATED", "DELETED"):
                    w["kinds"].append(self.next().upper)
                    self.op("|")
            if self.word("AND"):
                w["and"] = self.expression()
            while self.op("->"):
                if self.is_op("{", "${"):
                    w["actions"] = self.actions()
                elif self.now.kind in ("word", "name"):
                    w["next"] = self.name()
            self.op(",")
            out.append(w)
        return out


_UPPER_CALLS = {
    "COUNT", "SUM", "AVG", "MIN", "MAX", "ARGMIN", "ARGMAX", "VAR_POP", "VAR_SAMP", "STDDEV_POP", "STDDEV_SAMP", "HISTOGRAM", "CONCAT", "LOWER", "UPPER", "LENGTH", "POSITION", "SUBSTR", "REPLACE", "PAD",
    "BEGINS", "CONTAINS", "ENDS", "TESTBIT", "SETBIT", "RESETBIT", "BITFIELD", "ABS", "LN", "EXP", "POWER", "SQRT", "SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "FLOOR", "CEIL", "NORM", "TRACE", "TRANSPOSE", "DET", "INV", "RANK",
    "HASH", "TONUM", "TOINUM", "COALESCE", "ISCHANGED", "ISLOCAL", "DATAEVENTS",
}
