"""Whether the tokens of a Go file follow the language's grammar: a recursive descent over the published specification.

Nothing is built; the first token that fits nowhere is an error. Where the specification leaves a choice to later phases
(types and values look alike in many places) both pass.
"""

from __future__ import annotations

_LITERALS = frozenset(["number", "string", "raw", "rune"])
_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
_UNARY = frozenset("+ - ! ^ & ~ *".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_TYPE_STARTS = frozenset(["IDENT", "*", "[", "map", "chan", "<-", "func", "struct", "interface", "("])
#: What an expression can turn out to be: only some may be followed by a composite literal's brace, or be a statement's call.
NAME, TYPE, CALL, OTHER = range(4)


class Unexpected(ValueError):
    pass


class Parser:
    def __init__(self, symbols: list[str]):
        self.t, self.i, self.level = [*symbols, "EOF", "EOF", "EOF"], 0, 0

    @property
    def tok(self) -> str:
        return self.t[self.i]

    def fail(self) -> None:
        raise Unexpected(f"token {self.i}: {self.tok}")

    def accept(self, symbol: str) -> bool:
        if self.t[self.i] == symbol:
            self.i += 1
            return True
        return False

    def expect(self, symbol: str) -> None:
        if self.t[self.i] != symbol:
            self.fail()
        self.i += 1

    def end(self) -> None:
        """A semicolon, which a closing bracket stands for too."""
        if self.t[self.i] not in (")", "}"):
            if self.t[self.i] == "EOF":
                return
            self.expect(";")

    def attempt(self, rule, *then: str) -> bool:
        """Whether ``rule`` holds here and one of ``then`` follows; if not, nothing is taken."""
        start, level = self.i, self.level
        try:
            rule()
            if self.tok in then:
                return True
        except Unexpected:
            pass
        self.i, self.level = start, level
        return False

    # Declarations

    def file(self) -> None:
        self.expect("package")
        self.expect("IDENT")
        self.end()
        while self.tok == "import":
            self.declaration()
            self.end()
        while self.tok != "EOF":
            if self.tok == "func":
                self.function()
            elif self.tok in ("var", "const", "type"):
                self.declaration()
            elif self.tok != ";":
                self.fail()
            self.end()

    def declaration(self) -> None:
        spec, n = getattr(self, f"{self.tok}_spec"), 0
        self.i += 1
        if self.accept("("):
            while self.tok != ")":
                spec(n)
                self.end()
                n += 1
            self.expect(")")
        else:
            spec(n)

    def import_spec(self, n: int) -> None:
        if self.tok in ("IDENT", "."):
            self.i += 1
        self.expect("STRING")

    def names(self) -> None:
        self.expect("IDENT")
        while self.accept(","):
            self.expect("IDENT")

    def var_spec(self, n: int) -> None:
        self.names()
        if self.tok != "=":
            self.type()
        if self.accept("="):
            self.expressions()

    def const_spec(self, n: int) -> None:
        self.names()
        typed = self.tok not in ("=", ";", ")")
        if typed:
            self.type()
        if self.accept("="):
            self.expressions()
        elif typed or not n:
            self.fail()  # only what follows another constant may go without a value

    def type_spec(self, n: int) -> None:
        self.expect("IDENT")
        if self.tok == "[" and self.t[self.i + 1] == "IDENT":
            self.attempt(self.type_parameters, "=", *_TYPE_STARTS)  # else it is an array's length
        self.accept("=")
        self.type()

    def type_parameters(self) -> None:
        self.expect("[")
        while True:
            self.names()
            self.constraint()
            if not self.accept(",") or self.tok == "]":
                break
        self.expect("]")

    def constraint(self) -> None:
        while True:
            self.accept("~")
            self.type()
            if not self.accept("|"):
                return

    def function(self) -> None:
        self.expect("func")
        if self.tok == "(":
            self.parameters()
        self.expect("IDENT")
        if self.tok == "[":
            self.type_parameters()
        self.signature()
        if self.tok == "{":
            self.body()

    def signature(self) -> None:
        self.parameters()
        if self.tok == "(":
            self.parameters()
        elif self.tok in _TYPE_STARTS:
            self.type()

    def parameters(self) -> None:
        self.expect("(")
        kinds = []  # of each: "name" for a lone identifier, "typed" for one with a type, or "type"
        while self.tok != ")":
            if self.accept("..."):
                self.type()
                kinds.append("type")
            elif self.tok == "IDENT" and self.t[self.i + 1] in (",", ")"):
                self.i += 1
                kinds.append("name")
            elif self.tok == "IDENT" and self.t[self.i + 1] not in (".", "[") or self.tok == "IDENT" and self.t[self.i + 1] == "[" and not self.attempt(self.type, ",", ")"):
                self.i += 1
                self.accept("...")
                self.type()
                kinds.append("typed")
            elif self.tok in (",", ")"):
                kinds.append("type")
            else:
                self.type()
                kinds.append("type")
            if not self.accept(","):
                break
        self.expect(")")
        if "typed" in kinds and ("type" in kinds or kinds[-1] != "typed"):
            self.fail()

    # Types

    def type(self) -> None:
        tok = self.tok
        self.i += 1
        if tok == "IDENT":
            if self.tok == "." and self.t[self.i + 1] == "IDENT":
                self.i += 2
            if self.tok == "[" and self.t[self.i + 1] != "]":
                self.i += 1
                self.type()
                while self.accept(",") and self.tok != "]":
                    self.type()
                self.expect("]")
        elif tok == "*":
            self.type()
        elif tok == "[":
            self.length()
            self.type()
        elif tok == "map":
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif tok == "chan":
            self.accept("<-")
            self.type()
        elif tok == "<-":
            self.expect("chan")
            self.type()
        elif tok == "func":
            self.signature()
        elif tok == "struct":
            self.fields()
        elif tok == "interface":
            self.methods()
        elif tok == "(":
            self.type()
            self.expect(")")
        else:
            self.i -= 1
            self.fail()

    def length(self) -> None:
        """What is between an array's or slice's brackets, and the closing one."""
        if self.accept("]"):
            return
        if not self.accept("..."):
            self.inner(self.expression)
        self.expect("]")

    def fields(self) -> None:
        self.expect("{")
        while self.tok != "}":
            after = self.t[self.i + 1]
            if self.tok in ("*", "(") or self.tok == "IDENT" and after in (";", "}", ".", "STRING"):
                self.type()
            elif not (self.tok == "IDENT" and after == "[" and self.attempt(self.type, ";", "}", "STRING")):
                self.names()
                self.type()
            self.accept("STRING")
            self.end()
        self.expect("}")

    def methods(self) -> None:
        self.expect("{")
        while self.tok != "}":
            if self.tok == "IDENT" and self.t[self.i + 1] == "(":
                self.i += 1
                self.signature()
            else:
                self.constraint()
            self.end()
        self.expect("}")

    # Expressions

    def inner(self, rule):
        """``rule`` within brackets, where braces of composite literals can't be those of a statement."""
        level, self.level = self.level, max(self.level, 0) + 1
        out = rule()
        self.level = level
        return out

    def expressions(self) -> int:
        kind = self.expression()
        while self.accept(","):
            self.expression()
            kind = OTHER
        return kind

    def expression(self) -> int:
        kind = self.unary()
        while self.tok in _BINARY:
            self.i += 1
            self.unary()
            kind = OTHER
        return kind

    def unary(self) -> int:
        if self.tok in _UNARY:
            self.i += 1
            self.unary()
            return OTHER
        if self.tok == "<-":
            if self.t[self.i + 1] == "chan" and self.attempt(self.type, "(", ")", ",", "]", ";", "}", "{", ":", "EOF"):
                return self.suffixes(TYPE if self.tok != "{" else OTHER)
            self.i += 1
            self.unary()
            return OTHER
        return self.suffixes(self.operand())

    def operand(self) -> int:
        tok = self.tok
        if tok == "IDENT":
            self.i += 1
            return NAME
        if tok in ("LITERAL", "STRING"):
            self.i += 1
            return OTHER
        if tok == "(":
            self.i += 1
            self.inner(self.expression)
            self.expect(")")
            return OTHER
        if tok == "func":
            self.i += 1
            self.signature()
            if self.tok == "{":
                self.body()
            return OTHER
        if tok in ("[", "struct", "map"):
            self.type()
            return TYPE
        if tok in ("chan", "interface"):
            self.type()
            return OTHER
        self.fail()
        return OTHER

    def suffixes(self, kind: int) -> int:
        while True:
            tok = self.tok
            if tok == ".":
                self.i += 1
                if self.accept("("):
                    if not self.accept("type"):
                        self.type()
                    self.expect(")")
                    kind = OTHER
                else:
                    self.expect("IDENT")
                    kind = NAME if kind == NAME else OTHER
            elif tok == "[":
                self.i += 1
                self.inner(self.index)
                self.expect("]")
                kind = NAME if kind == NAME else OTHER
            elif tok == "(":
                self.i += 1
                self.inner(self.arguments)
                self.expect(")")
                kind = CALL
            elif tok == "{" and (kind == TYPE or kind == NAME and self.level >= 0):
                self.literal()
                kind = OTHER
            else:
                return kind

    def index(self) -> None:
        colons = 0
        if self.tok == "]":
            self.fail()
        while self.tok != "]":
            if self.tok == ":":
                self.i += 1
                colons += 1
                if colons > 2 or colons == 2 and (self.t[self.i - 2] == ":" or self.tok == "]"):
                    self.fail()  # the middle and last of three have to be there
            elif self.tok == ",":
                if colons:
                    self.fail()
                self.i += 1
            else:
                self.expression()
                if self.tok not in ("]", ":", ","):
                    self.fail()

    def arguments(self) -> None:
        while self.tok != ")":
            self.expression()
            self.accept("...")
            if not self.accept(","):
                return

    def literal(self) -> None:
        def elements() -> None:
            while self.tok != "}":
                for part in range(2):
                    self.literal() if self.tok == "{" else self.expression()
                    if part or not self.accept(":"):
                        break
                if not self.accept(","):
                    return

        self.expect("{")
        self.inner(elements)
        self.expect("}")

    # Statements

    def body(self) -> None:
        level, self.level = self.level, 0
        self.block()
        self.level = level

    def block(self) -> None:
        self.expect("{")
        self.statements()
        self.expect("}")

    def statements(self) -> None:
        while self.tok not in ("}", "case", "default", "EOF"):
            self.statement()
            if self.tok not in ("}", "case", "default"):
                self.expect(";")

    def statement(self) -> None:
        tok = self.tok
        if tok in ("const", "type", "var"):
            self.declaration()
        elif tok == "{":
            self.block()
        elif tok in ("if", "for", "switch", "select"):
            getattr(self, f"{tok}_statement")()
        elif tok == "return":
            self.i += 1
            if self.tok not in (";", "}"):
                self.expressions()
        elif tok in ("break", "continue"):
            self.i += 1
            self.accept("IDENT")
        elif tok == "goto":
            self.i += 1
            self.expect("IDENT")
        elif tok == "fallthrough":
            self.i += 1
        elif tok in ("go", "defer"):
            self.i += 1
            if self.expression() != CALL:
                self.fail()
        elif tok == "IDENT" and self.t[self.i + 1] == ":":
            self.i += 2
            if self.tok != "}":
                self.statement()
        elif tok != ";":
            self.simple()

    def simple(self, ranges: bool = False) -> str:
        """A simple statement; whether it is an expression ("value"), a range clause ("range") or something else ("other")."""
        if ranges and self.accept("range"):
            self.expression()
            return "range"
        self.expressions()
        several = self.tok
        if self.tok in _ASSIGN:
            self.i += 1
            if ranges and several in ("=", ":=") and self.accept("range"):
                self.expression()
                return "range"
            self.expressions()
            return "other"
        if self.accept("<-"):
            self.expression()
            return "other"
        if self.accept("++") or self.accept("--"):
            return "other"
        return "value"

    def header(self, rule) -> None:
        level, self.level = self.level, -1
        rule()
        self.level = level

    def if_statement(self) -> None:
        def head() -> None:
            kind = self.simple() if self.tok != ";" else "other"
            if self.accept(";"):
                kind = self.simple()
            if kind != "value":
                self.fail()

        self.expect("if")
        self.header(head)
        self.block()
        if self.accept("else"):
            if self.tok == "if":
                self.if_statement()
            else:
                self.block()

    def for_statement(self) -> None:
        def head() -> None:
            if self.tok == "{":
                return
            kind = self.simple(True) if self.tok != ";" else "other"
            if kind == "range":
                return
            if self.tok != ";":
                if kind != "value":
                    self.fail()
                return
            self.i += 1
            if self.tok != ";" and self.simple() != "value":
                self.fail()
            self.expect(";")
            if self.tok != "{":
                self.simple()

        self.expect("for")
        self.header(head)
        self.block()

    def switch_statement(self) -> None:
        def head() -> None:
            if self.tok not in ("{", ";"):
                self.simple()
            if self.accept(";") and self.tok != "{":
                self.simple()

        self.expect("switch")
        self.header(head)
        self.clauses(self.case_types)

    def case_types(self) -> None:
        while True:
            self.expression()
            if not self.accept(","):
                return

    def select_statement(self) -> None:
        self.expect("select")
        self.clauses(self.simple)

    def clauses(self, case) -> None:
        self.expect("{")
        while self.tok != "}":
            if self.accept("case"):
                case()
            else:
                self.expect("default")
            self.expect(":")
            self.statements()
        self.expect("}")


def check(tokens, keywords: frozenset[str]) -> None:
    """Raises ``Unexpected`` if ``tokens`` (each with kind and text) are no file. What is nested too deep for it passes."""
    symbols = ["STRING" if t.kind in ("string", "raw") else "LITERAL" if t.kind in _LITERALS else "IDENT" if t.kind == "ident" and t.text not in keywords else t.text for t in tokens]
    try:
        Parser(symbols).file()
    except RecursionError:
        pass
