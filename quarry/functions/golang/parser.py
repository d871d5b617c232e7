"""Parser of Go source, by the public language specification, to trees of named tuples.

A composite literal's brace is told from a block's by the depth of brackets: in the header of a
control statement, outside brackets, a brace behind a type name opens the block. Parameter lists are
read as entries of a name, a type or both, and settled at their end; in a type declaration, what
stands in brackets is read as an expression and then settled to be a length or type parameters.
"""

from __future__ import annotations

from collections import namedtuple

from quarry.functions.golang.scanner import SyntaxFault, scan

Ident = namedtuple("Ident", "name")
Basic = namedtuple("Basic", "kind text")
Binary = namedtuple("Binary", "x op y")
Unary = namedtuple("Unary", "op x")
Star = namedtuple("Star", "x")
Paren = namedtuple("Paren", "x")
Selector = namedtuple("Selector", "x name")
Index = namedtuple("Index", "x indices")
Slice = namedtuple("Slice", "x bounds")
Assert = namedtuple("Assert", "x type")
Call = namedtuple("Call", "fun args spread")
KeyValue = namedtuple("KeyValue", "key value")
Composite = namedtuple("Composite", "type elements")
FuncLit = namedtuple("FuncLit", "type body")
Ellipsis_ = namedtuple("Ellipsis_", "type")
Array = namedtuple("Array", "length type")
Map = namedtuple("Map", "key value")
Chan = namedtuple("Chan", "direction value")
Func = namedtuple("Func", "type_params params results")
Struct = namedtuple("Struct", "fields")
Interface = namedtuple("Interface", "fields")
Field = namedtuple("Field", "names type")
Block = namedtuple("Block", "body")
Expr = namedtuple("Expr", "x")
Assign = namedtuple("Assign", "left op right")
IncDec = namedtuple("IncDec", "x op")
Return = namedtuple("Return", "results")
Branch = namedtuple("Branch", "kind label")
If = namedtuple("If", "init cond body other")
For = namedtuple("For", "init cond post body")
Range = namedtuple("Range", "key value op x body")
Switch = namedtuple("Switch", "init tag body")
TypeSwitch = namedtuple("TypeSwitch", "init guard body")
Case = namedtuple("Case", "values body")
Select = namedtuple("Select", "body")
Comm = namedtuple("Comm", "stmt body")
Go = namedtuple("Go", "call")
Defer = namedtuple("Defer", "call")
Send = namedtuple("Send", "chan value")
Labeled = namedtuple("Labeled", "label stmt")
Empty = namedtuple("Empty", "")
Decl = namedtuple("Decl", "keyword specs")
Import = namedtuple("Import", "name path")
Value = namedtuple("Value", "names type values")
Type = namedtuple("Type", "name params type")
FuncDecl = namedtuple("FuncDecl", "recv name type body")
#: What a range clause is until its statement takes it apart.
RangeClause = namedtuple("RangeClause", "left op x")

LEVEL = {"||": 1, "&&": 2, **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), 3), **dict.fromkeys("+-|^", 4), **dict.fromkeys(("*", "/", "%", "<<", ">>", "&", "&^"), 5)}
ASSIGNS = frozenset(("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="))
LITERALS = frozenset(("INT", "FLOAT", "IMAG", "CHAR", "STRING"))
STARTS = LITERALS | frozenset(("IDENT", "func", "(", "[", "struct", "map", "chan", "interface", "+", "-", "*", "&", "^", "<-", "!", "~"))
NOT_IN_PATHS = frozenset("!\"#$%&'()*,:;<=>?[\\]^{|}`�")


class Parser:
    def __init__(self, source: str):
        self.tokens = scan(source)
        self.at = 0
        self.kind, self.text, self.place = self.tokens[0]
        self.depth = 0  # of brackets; below 0 in the header of a control statement

    # --- tokens ---
    def next(self) -> str:
        text = self.text
        if self.kind != "EOF":
            self.at += 1
            self.kind, self.text, self.place = self.tokens[self.at]
        return text

    def fault(self, message: str):
        raise SyntaxFault(f"{message}, found {self.text!r}" if self.kind != "EOF" else f"{message}, found the end", self.place)

    def want(self, kind: str) -> str:
        if self.kind != kind:
            self.fault(f"expected {kind}")
        return self.next()

    def took(self, kind: str) -> bool:
        if self.kind == kind:
            self.next()
            return True
        return False

    def semicolon(self) -> None:
        if self.kind not in (")", "}"):
            self.want(";")

    def ident(self) -> Ident:
        return Ident(self.want("IDENT"))

    def idents(self) -> list[Ident]:
        out = [self.ident()]
        while self.took(","):
            out.append(self.ident())
        return out

    # --- the file ---
    def file(self) -> list:
        self.want("package")
        if self.ident().name == "_":
            self.fault("invalid package name _")
        self.semicolon()
        decls, imports = [], True
        while self.kind != "EOF":
            if self.kind == "import":
                if not imports:
                    self.fault("imports must appear before other declarations")
            else:
                imports = False
            decls.append(self.func_decl() if self.kind == "func" else self.declaration())
            if self.kind != "EOF":
                self.want(";")
        return decls

    def declaration(self) -> Decl:
        keyword = self.kind
        one = {"import": self.import_spec, "const": self.value_spec, "var": self.value_spec, "type": self.type_spec}.get(keyword)
        if one is None:
            self.fault("expected declaration")
        self.next()
        if not self.took("("):
            return Decl(keyword, [one(keyword, 0)])
        specs = []
        while self.kind not in (")", "EOF"):
            specs.append(one(keyword, len(specs)))
            self.semicolon()
        self.want(")")
        return Decl(keyword, specs)

    def import_spec(self, _keyword: str, _number: int) -> Import:
        name = self.next() if self.kind in ("IDENT", ".") else None
        if self.kind != "STRING":
            self.fault("missing import path")
        inside = self.text[1:-1]
        if not inside or any(c in NOT_IN_PATHS or c.isspace() or not c.isprintable() for c in inside):
            self.fault("invalid import path")
        return Import(name, self.next())

    def value_spec(self, keyword: str, number: int) -> Value:
        names = self.idents()
        type_ = self.type() if self.kind not in ("=", ";", ")", "}", "EOF") else None
        values = self.expressions() if self.took("=") else []
        if keyword == "var" and type_ is None and not values:
            self.fault("missing type or initial value")
        if keyword == "const" and not values and (number == 0 or type_ is not None):
            self.fault("missing value of a constant")
        return Value(names, type_, values)

    def type_spec(self, _keyword: str, _number: int) -> Type:
        name = self.ident()
        if self.kind != "[":
            self.took("=")
            return Type(name, None, self.type())
        self.next()
        if self.kind != "IDENT":
            return Type(name, None, self.array_rest())
        first = self.ident()
        x = first
        if self.kind != "[":
            self.depth += 1
            x = self.binary(1, self.primary(first))
            self.depth -= 1
        param, bound = self.as_type_param(x, self.kind == ",")
        if param is not None and (bound is not None or self.kind != "]"):
            params = self.fields(self.entries("]", True, (param, bound)), True)
            self.want("]")
            self.took("=")
            return Type(name, params, self.type())
        self.want("]")
        return Type(name, None, Array(x, self.type()))

    def as_type_param(self, x, force: bool):
        """(name, bound or None) if x can begin type parameters; force says that it must."""
        if isinstance(x, Ident):
            return x, None
        if isinstance(x, Binary) and isinstance(x.x, Ident) and x.op == "*" and (force or self.type_only(x.y)):
            return x.x, Star(x.y)
        if isinstance(x, Binary) and x.op == "|":
            name, left = self.as_type_param(x.x, force or self.type_only(x.y))
            if name is not None and left is not None:
                return name, Binary(left, "|", x.y)
        if isinstance(x, Call) and isinstance(x.fun, Ident) and len(x.args) == 1 and not x.spread and (force or self.type_only(x.args[0])):
            return x.fun, Paren(x.args[0])
        return None, None

    def type_only(self, x) -> bool:
        if isinstance(x, Binary):
            return self.type_only(x.x) or self.type_only(x.y)
        if isinstance(x, Paren):
            return self.type_only(x.x)
        return isinstance(x, (Array, Struct, Func, Interface, Map, Chan)) or isinstance(x, Unary) and x.op == "~"

    def func_decl(self) -> FuncDecl:
        self.want("func")
        recv = self.params() if self.kind == "(" else None
        name = self.ident()
        type_params = None
        if self.took("["):
            if self.kind == "]":
                self.fault("empty type parameter list")
            type_params = self.fields(self.entries("]", True), True)
            self.want("]")
            if recv is not None:
                self.fault("a method has no type parameters")
        type_ = Func(type_params, self.params(), self.results())
        return FuncDecl(recv, name, type_, self.body() if self.kind == "{" else None)

    def body(self) -> Block:
        held, self.depth = self.depth, 0
        block = self.block()
        self.depth = held
        return block

    # --- types ---
    def type(self):
        found = self.maybe_type()
        if found is None:
            self.fault("expected type")
        return found

    def maybe_type(self):
        kind = self.kind
        if kind == "IDENT":
            name = self.type_name()
            return self.instance(name) if self.kind == "[" else name
        if kind == "[":
            self.next()
            return self.array_rest()
        if kind == "struct":
            return self.struct()
        if kind == "*":
            self.next()
            return Star(self.type())
        if kind == "func":
            self.next()
            return Func(None, self.params(), self.results())
        if kind == "interface":
            return self.interface()
        if kind == "map":
            self.next()
            self.want("[")
            key = self.type()
            self.want("]")
            return Map(key, self.type())
        if kind in ("chan", "<-"):
            return self.chan()
        if kind == "(":
            self.next()
            inner = self.type()
            self.want(")")
            return Paren(inner)
        return None

    def type_name(self):
        name = self.ident()
        return Selector(name, self.ident().name) if self.took(".") else name

    def instance(self, name) -> Index:
        self.want("[")
        self.depth += 1
        given = [self.type()]
        while self.took(",") and self.kind != "]":
            given.append(self.type())
        self.depth -= 1
        self.want("]")
        return Index(name, given)

    def array_rest(self) -> Array:
        """Behind the bracket."""
        if self.took("]"):
            return Array(None, self.type())
        if self.took("..."):
            length = Ellipsis_(None)
        else:
            self.depth += 1
            length = self.expression()
            self.depth -= 1
        self.want("]")
        return Array(length, self.type())

    def chan(self) -> Chan:
        if self.took("<-"):
            self.want("chan")
            return Chan("RECV", self.type())
        self.want("chan")
        return Chan("SEND" if self.took("<-") else "BI", self.type())

    def struct(self) -> Struct:
        self.want("struct")
        self.want("{")
        fields = []
        while self.kind not in ("}", "EOF"):
            fields.append(self.struct_field())
            self.took("STRING")
            self.semicolon()
        self.want("}")
        return Struct(fields)

    def struct_field(self) -> Field:
        if self.took("*"):
            return Field([], Star(self.embedded()))
        if self.kind != "IDENT":
            self.fault("expected field name or embedded type")
        name = self.ident()
        if self.kind in (".", "STRING", "}", ";"):
            if self.took("."):
                name = Selector(name, self.ident().name)
                name = self.instance(name) if self.kind == "[" else name
            return Field([], name)
        if self.kind == "[":
            named, type_ = self.array_or_instance(name)
            return Field([name], type_) if named else Field([], type_)
        names = [name]
        while self.took(","):
            names.append(self.ident())
        return Field(names, self.type())

    def embedded(self):
        name = self.type_name()
        return self.instance(name) if self.kind == "[" else name

    def array_or_instance(self, name: Ident):
        """Behind a name, at a bracket: (True, the array type of a thing of that name) or (False,
        an instance of the generic type of that name)."""
        self.want("[")
        if self.took("]"):
            return True, Array(None, self.type())
        if self.took("..."):
            self.want("]")
            return True, Array(Ellipsis_(None), self.type())
        self.depth += 1
        given = [self.type_or_expression()]
        while self.took(",") and self.kind != "]":
            given.append(self.type_or_expression())
        several = len(given) > 1 or self.tokens[self.at - 1][0] == ","
        self.depth -= 1
        self.want("]")
        if not several and (element := self.maybe_type()) is not None:
            return True, Array(given[0], element)
        return False, Index(name, given)

    def interface(self) -> Interface:
        self.want("interface")
        self.want("{")
        fields = []
        while self.kind not in ("}", "EOF"):
            if self.kind == "IDENT" and self.tokens[self.at + 1][0] == "(":
                name = self.ident()
                fields.append(Field([name], Func(None, self.params(), self.results())))
            else:
                fields.append(Field([], self.union()))
            self.semicolon()
        self.want("}")
        return Interface(fields)

    def union(self, first=None):
        x = self.term() if first is None else first
        while self.took("|"):
            x = Binary(x, "|", self.term())
        return x

    def term(self):
        return Unary("~", self.type()) if self.took("~") else self.type()

    # --- parameters ---
    def params(self) -> list[Field]:
        self.want("(")
        found = self.fields(self.entries(")", False), False)
        self.want(")")
        return found

    def results(self) -> list[Field] | None:
        if self.kind == "(":
            return self.params()
        type_ = self.maybe_type()
        return None if type_ is None else [Field([], type_)]

    def entries(self, close: str, type_params: bool, first: tuple | None = None) -> list[tuple]:
        """(name or None, type or None) up to the closing bracket; first has been read before, its
        type perhaps in part."""
        out = []
        while self.kind not in (close, "EOF") or first:
            out.append(self.entry(type_params, *(first or ())))
            first = None
            if not self.took(","):
                break
        return out

    def entry(self, type_params: bool, name: Ident | None = None, type_=None) -> tuple:
        bound = self.union if type_params else self.type
        if type_ is not None:
            return name, self.union(type_)
        if name is None and self.kind != "IDENT":
            if self.took("..."):
                return None, Ellipsis_(self.type())
            return None, bound()
        name = name or self.ident()
        if self.kind == ".":
            self.next()
            qualified = Selector(name, self.ident().name)
            qualified = self.instance(qualified) if self.kind == "[" else qualified
            return None, self.union(qualified) if type_params else qualified
        if self.kind == "[":
            named, type_ = self.array_or_instance(name)
            type_ = self.union(type_) if type_params else type_
            return (name if named else None), type_
        if self.took("..."):
            return name, Ellipsis_(self.type())
        if type_params and self.kind == "~":
            return name, self.union()
        if type_params and self.kind == "|":
            return None, self.union(name)
        if (type_ := self.maybe_type()) is not None:
            return name, self.union(type_) if type_params else type_
        return name, None  # a name or a type; the whole list tells

    def fields(self, entries: list[tuple], type_params: bool) -> list[Field]:
        if not any(n is not None and t is not None for n, t in entries):
            if type_params and entries:
                self.fault("type parameters must be named")
            return [Field([], n if t is None else t) for n, t in entries]
        out: list[Field] = []
        names: list[Ident] = []
        for name, type_ in entries:
            if name is None:
                self.fault("mixed named and unnamed parameters")
            names.append(name)
            if type_ is not None:
                out.append(Field(names, type_))
                names = []
        if names:
            self.fault("missing parameter type")
        return out

    # --- expressions ---
    def expressions(self) -> list:
        out = [self.expression()]
        while self.took(","):
            out.append(self.expression())
        return out

    def expression(self):
        return self.binary(1, self.unary())

    type_or_expression = expression  # types are operands

    def binary(self, level: int, x):
        while (own := LEVEL.get(self.kind, 0)) >= level:
            op = self.next()
            x = Binary(x, op, self.binary(own + 1, self.unary()))
        return x

    def unary(self):
        if self.kind in ("+", "-", "!", "^", "&", "~"):
            op = self.next()
            return Unary(op, self.unary())
        if self.kind == "*":
            self.next()
            return Star(self.unary())
        if self.kind == "<-":
            self.next()
            x = self.unary()
            return self.receiving(x) if isinstance(x, Chan) else Unary("<-", x)
        return self.primary(None)

    def receiving(self, x) -> Chan:
        """The channel type that an arrow and this channel type make together."""
        if not isinstance(x, Chan) or x.direction == "RECV":
            self.fault("unexpected <- before a type")
        return Chan("RECV", self.receiving(x.value) if x.direction == "SEND" else x.value)

    def operand(self):
        if self.kind == "IDENT":
            return self.ident()
        if self.kind in LITERALS:
            return Basic(self.kind, self.next())
        if self.kind == "(":
            self.next()
            self.depth += 1
            x = self.type_or_expression()
            self.depth -= 1
            self.want(")")
            return Paren(x)
        if self.kind == "func":
            self.next()
            type_ = Func(None, self.params(), self.results())
            return FuncLit(type_, self.body()) if self.kind == "{" else type_
        type_ = self.maybe_type()
        if type_ is None:
            self.fault("expected operand")
        return type_

    def primary(self, x):
        x = self.operand() if x is None else x
        while True:
            if self.kind == ".":
                self.next()
                if self.kind == "IDENT":
                    x = Selector(x, self.next())
                elif self.took("("):
                    type_ = None if self.took("type") else self.type()
                    self.want(")")
                    x = Assert(x, type_)
                else:
                    self.fault("expected selector or type assertion")
            elif self.kind == "[":
                x = self.index(x)
            elif self.kind == "(":
                x = self.call(x)
            elif self.kind == "{" and self.literal_type(x):
                x = self.composite(x)
            else:
                return x

    def literal_type(self, x) -> bool:
        if isinstance(x, Index):
            x = x.x
        if isinstance(x, Ident) or isinstance(x, Selector) and isinstance(x.x, Ident):
            return self.depth >= 0
        return isinstance(x, (Array, Struct, Map))

    def index(self, x):
        self.want("[")
        if self.kind == "]":
            self.fault("expected operand")
        self.depth += 1
        parts, colons, commas = [], 0, False
        if self.kind != ":":
            parts.append(self.type_or_expression())
            while self.kind == "," and not colons:
                self.next()
                commas = True
                if self.kind != "]":
                    parts.append(self.type_or_expression())
        if not commas:
            bounds = [parts[0] if parts else None]
            while self.kind == ":" and colons < 2:
                self.next()
                colons += 1
                bounds.append(self.expression() if self.kind not in (":", "]", "EOF") else None)
        self.depth -= 1
        self.want("]")
        if colons == 2 and None in bounds[1:]:
            self.fault("middle and final index required in 3-index slice")
        return Slice(x, bounds) if colons else Index(x, parts)

    def call(self, fun) -> Call:
        self.want("(")
        self.depth += 1
        args, spread = [], False
        while self.kind not in (")", "EOF") and not spread:
            args.append(self.type_or_expression())
            spread = self.took("...")
            if not self.took(","):
                break
        self.depth -= 1
        self.want(")")
        return Call(fun, args, spread)

    def composite(self, type_) -> Composite:
        self.want("{")
        held, self.depth = self.depth, max(self.depth, 0) + 1
        elements = []
        while self.kind not in ("}", "EOF"):
            x = self.element()
            elements.append(KeyValue(x, self.element()) if self.took(":") else x)
            if not self.took(","):
                break
        self.depth = held
        self.want("}")
        return Composite(type_, elements)

    def element(self):
        return self.composite(None) if self.kind == "{" else self.expression()

    # --- statements ---
    def block(self) -> Block:
        self.want("{")
        body = self.statements()
        self.want("}")
        return Block(body)

    def statements(self) -> list:
        out = []
        while self.kind not in ("case", "default", "}", "EOF"):
            out.append(self.statement())
        return out

    def statement(self):
        kind = self.kind
        if kind in ("const", "type", "var"):
            decl = self.declaration()
            self.semicolon()
            return decl
        if kind in STARTS:
            stmt = self.simple(label=True)
            if not isinstance(stmt, Labeled):
                self.semicolon()
            return stmt
        if kind == "{":
            stmt = self.block()
        elif kind == "if":
            return self.if_()
        elif kind in ("for", "switch", "select"):
            stmt = {"for": self.for_, "switch": self.switch, "select": self.select}[kind]()
        elif kind in ("go", "defer"):
            self.next()
            call = self.expression()
            if not isinstance(call, Call):
                self.fault(f"expression in {kind} must be a function call")
            stmt = (Go if kind == "go" else Defer)(call)
        elif kind == "return":
            self.next()
            stmt = Return(self.expressions() if self.kind not in (";", "}") else [])
        elif kind in ("break", "continue", "goto", "fallthrough"):
            self.next()
            stmt = Branch(kind, self.ident() if kind != "fallthrough" and self.kind == "IDENT" else None)
        elif kind == ";":
            self.next()
            return Empty()
        elif kind == "}":
            return Empty()
        else:
            self.fault("expected statement")
        self.semicolon()
        return stmt

    def simple(self, label: bool = False, ranges: bool = False):
        left = self.expressions()
        if self.kind in ASSIGNS:
            op = self.next()
            if ranges and self.kind == "range" and op in ("=", ":="):
                self.next()
                return RangeClause(left, op, self.expression())
            return Assign(left, op, self.expressions())
        if len(left) > 1:
            self.fault("expected one expression")
        x = left[0]
        if self.kind == ":" and label and isinstance(x, Ident):
            self.next()
            return Labeled(x, self.statement())
        if self.kind == "<-":
            self.next()
            return Send(x, self.expression())
        if self.kind in ("++", "--"):
            return IncDec(x, self.next())
        return Expr(x)

    def header(self):
        """Enters the header of a control statement; gives back the depth to return to."""
        held, self.depth = self.depth, -1
        return held

    def condition(self, stmt):
        if stmt is not None and not isinstance(stmt, Expr):
            self.fault("expected an expression, not a statement")
        return None if stmt is None else stmt.x

    def if_(self) -> If:
        self.want("if")
        held = self.header()
        if self.kind == "{":
            self.fault("missing condition")
        init, cond = None, None
        if self.kind != ";":
            cond = self.simple()
        if self.kind == ";":
            if self.text == "\n":
                self.fault("unexpected newline")
            self.next()
            init, cond = cond, None
            if self.kind == "{":
                self.fault("missing condition")
            cond = self.simple()
        cond = self.condition(cond)
        self.depth = held
        body, other = self.block(), None
        if self.took("else"):
            if self.kind == "if":
                return If(init, cond, body, self.if_())
            if self.kind != "{":
                self.fault("expected if statement or block")
            other = self.block()
        self.semicolon()
        return If(init, cond, body, other)

    def for_(self):
        self.want("for")
        held = self.header()
        init = cond = post = clause = None
        if self.kind != "{":
            if self.took("range"):
                clause = RangeClause([], None, self.expression())
            elif self.kind != ";":
                cond = self.simple(ranges=True)
                if isinstance(cond, RangeClause):
                    clause = cond
            if clause is None and self.kind == ";":
                self.next()
                init, cond = cond, None
                if self.kind != ";":
                    if self.kind == "{":
                        self.fault("expected for loop condition")
                    cond = self.simple()
                self.want(";")
                if self.kind != "{":
                    post = self.simple()
        self.depth = held
        body = self.block()
        if clause is None:
            return For(init, self.condition(cond), post, body)
        if len(clause.left) > 2:
            self.fault("expected at most 2 expressions")
        key, value = (*clause.left, None, None)[:2]
        return Range(key, value, clause.op, clause.x, body)

    def switch(self):
        self.want("switch")
        held = self.header()
        init = tag = None
        if self.kind != "{":
            if self.kind != ";":
                tag = self.simple()
            if self.kind == ";":
                self.next()
                init, tag = tag, None
                if self.kind != "{":
                    tag = self.simple()
        self.depth = held
        guard = self.guards(tag)
        self.want("{")
        clauses = []
        while self.kind in ("case", "default"):
            values = [] if self.next() == "default" else self.expressions()
            self.want(":")
            clauses.append(Case(values, self.statements()))
        self.want("}")
        if guard:
            return TypeSwitch(init, tag, Block(clauses))
        return Switch(init, self.condition(tag), Block(clauses))

    def guards(self, stmt) -> bool:
        if isinstance(stmt, Expr):
            return isinstance(stmt.x, Assert) and stmt.x.type is None
        if isinstance(stmt, Assign) and len(stmt.left) == len(stmt.right) == 1 and isinstance(stmt.right[0], Assert) and stmt.right[0].type is None:
            if stmt.op == "=":
                self.fault("expected := in a type switch")
            return stmt.op == ":="
        return False

    def select(self) -> Select:
        self.want("select")
        self.want("{")
        clauses = []
        while self.kind in ("case", "default"):
            stmt = None
            if self.next() == "case":
                stmt = self.simple()
                if isinstance(stmt, (IncDec, Labeled)) or isinstance(stmt, Assign) and (stmt.op not in ("=", ":=") or len(stmt.left) > 2 or len(stmt.right) != 1):
                    self.fault("expected a send or receive")
            self.want(":")
            clauses.append(Comm(stmt, self.statements()))
        self.want("}")
        return Select(Block(clauses))


def parse(source: str) -> list:
    """The declarations of a file."""
    return Parser(source).file()
