"""The token walk over a parsed Go file: brackets for nodes, scoped slots for names.

One flat list holds the names in scope, the innermost last, and a name's slot is its place there; a
scope is a mark to cut the list back to. Fields have a numbering of their own by first appearance in
the file. What this scheme does in corners is part of the format: the names of a function type's
parameters stay in the scope around it, a ``:=`` brings its names in before its right side is read,
and an inner declaration of a name that is bound anywhere takes that binding's slot.
"""

from __future__ import annotations

import ast
import posixpath
import re

from quarry.functions.golang import parser as p
from quarry.functions.vocab import FIELD_SLOTS, NAME_SLOTS

# Tokens of predeclared names, operators, literals, directions and branches.
BUILTINS = "len cap panic recover make new append copy delete close complex real imag print println nil true false iota".split()
TYPES = "bool byte rune string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 error any comparable".split()
PREDECLARED = {n: f"BI_{n.upper()}" for n in BUILTINS} | {n: f"T_{n.upper()}" for n in TYPES}
OPERATORS = {
    "+": "ADD", "-": "SUB", "*": "MUL", "/": "QUO", "%": "REM", "&": "AND", "|": "OR", "^": "XOR", "<<": "SHL", ">>": "SHR", "&^": "ANDNOT",
    "&&": "LAND", "||": "LOR", "<-": "ARROW", "++": "INC", "--": "DEC", "==": "EQL", "!=": "NEQ", "<": "LSS", ">": "GTR", "<=": "LEQ", ">=": "GEQ", "!": "NOT",
    "=": "ASSIGN", ":=": "DEFINE", "+=": "ADD_ASSIGN", "-=": "SUB_ASSIGN", "*=": "MUL_ASSIGN", "/=": "QUO_ASSIGN", "%=": "REM_ASSIGN",
    "&=": "AND_ASSIGN", "|=": "OR_ASSIGN", "^=": "XOR_ASSIGN", "<<=": "SHL_ASSIGN", ">>=": "SHR_ASSIGN", "&^=": "ANDNOT_ASSIGN",
}
LITERALS = {"INT": "INT_LIT", "FLOAT": "FLOAT_LIT", "IMAG": "IMAG_LIT", "CHAR": "CHAR_LIT", "STRING": "STRING_LIT"}
BRANCHES = {"break": "BR_BREAK", "continue": "BR_CONTINUE", "goto": "BR_GOTO", "fallthrough": "BR_FALLTHROUGH"}
DECLARATIONS = {"var": "VAR_DECL", "const": "CONST_DECL", "type": "TYPE_DECL"}


def import_name(quoted: str) -> str:
    """The name that an import path gives: its last part that is no version, as far as it has one."""
    path = quoted[1:-1] if quoted[0] == "`" else ast.literal_eval(quoted) if "\\" in quoted else quoted[1:-1]
    path = path.rstrip("/") or path[:1]
    while re.fullmatch(r"v[0-9]+", posixpath.basename(path)) and posixpath.dirname(path).rstrip("/") not in ("", "."):
        path = posixpath.dirname(path)
    return posixpath.basename(path) or path


class Walk:
    def __init__(self):
        self.out: list[str] = []
        self.names: list[str] = []
        self.slots: dict[str, list[int]] = {}  # of each name in scope, the innermost last
        self.field_of: dict[str, int] = {}

    # --- names ---
    def slot(self, i: int) -> None:
        self.out.append(f"NAME_{i}" if i < NAME_SLOTS else "NAME_OVF")

    def bound(self, name: str) -> int:
        """The innermost slot of a name, -1 without."""
        own = self.slots.get(name)
        return own[-1] if own else -1

    def bind(self, name: str) -> None:
        self.slots.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def leave(self, mark: int) -> None:
        """Ends what came into scope since there were `mark` names."""
        while len(self.names) > mark:
            self.slots[self.names.pop()].pop()

    def introduce(self, name: str) -> None:
        if name == "_":
            self.out.append("NAME_BLANK")
        else:
            self.bind(name)
            self.slot(len(self.names) - 1)

    def refer(self, name: str) -> None:
        if name == "_":
            self.out.append("NAME_BLANK")
        elif name in PREDECLARED:
            self.out.append(PREDECLARED[name])
        elif (i := self.bound(name)) >= 0:
            self.slot(i)
        else:
            self.out.append("NAME_UNK")

    def declare(self, name: str) -> None:
        if name != "_" and self.bound(name) >= 0:
            self.refer(name)
        else:
            self.introduce(name)

    def field(self, name: str) -> None:
        i = self.field_of.setdefault(name, len(self.field_of))
        self.out.append(f"FIELD_{i}" if i < FIELD_SLOTS else "FIELD_OVF")

    # --- trees ---
    def wrap(self, kind: str, *nodes, scope: bool = False) -> None:
        """A bracket around nodes; strings among them are tokens, callables are called."""
        mark = len(self.names)
        self.out.append(f"OPEN_{kind}")
        for n in nodes:
            self.walk(n)
        if scope:
            self.leave(mark)
        self.out.append(f"CLOSE_{kind}")

    def walk(self, n) -> None:
        if n is None:
            return
        if isinstance(n, str):
            self.out.append(n)
        elif type(n) is list:
            for x in n:
                self.walk(x)
        elif callable(n):
            n()
        else:
            _RULES[type(n)](self, n)

    def field_list(self, fields: list[p.Field], name) -> None:
        for f in fields:
            self.wrap("FIELD", *((lambda x=x: name(x.name)) for x in f.names), f.type)

    def func_type(self, f: p.Func) -> None:
        def part(kind: str, fields):
            return None if fields is None else lambda: self.wrap(kind, lambda: self.field_list(fields, self.introduce))

        self.wrap("FUNC_TYPE", part("TYPE_PARAMS", f.type_params), part("PARAMS", f.params), part("RESULTS", f.results))

    def func_decl(self, n: p.FuncDecl) -> None:
        def head():
            if n.recv is None:
                self.refer(n.name.name)
            else:
                self.wrap("RECV", lambda: self.field_list(n.recv, self.introduce))
                self.field(n.name.name)

        self.wrap("FUNC_DECL", head, n.type, n.body, scope=True)

    def assign(self, n: p.Assign) -> None:
        left = [(lambda x=x: self.introduce(x.name)) if n.op == ":=" and isinstance(x, p.Ident) else x for x in n.left]
        self.wrap("ASSIGN", left, _op(n.op), n.right)

    def range_(self, n: p.Range) -> None:
        left = [n.key, n.value]
        if n.op == ":=":
            left = [(lambda x=x: self.introduce(x.name)) for x in left if isinstance(x, p.Ident)]
        self.wrap("RANGE", left, n.x, n.body, scope=True)

    def type_spec(self, n: p.Type) -> None:
        def rest():
            mark = len(self.names)
            if n.params is not None:
                self.field_list(n.params, self.introduce)
            self.walk(n.type)
            if n.params is not None:
                self.leave(mark)

        self.wrap("TYPE_SPEC", lambda: self.declare(n.name.name), rest)

    def labeled(self, n: p.Labeled) -> None:
        self.wrap("LABELED", lambda: self.introduce(n.label.name), n.stmt)

    def package_names(self, decls: list) -> None:
        """Binds what the package declares, in order, before any of it is walked."""
        for d in decls:
            if isinstance(d, p.FuncDecl):
                found = [d.name.name] if d.recv is None else []
            else:
                found = []
                for s in d.specs:
                    if isinstance(s, p.Import):
                        found.append(import_name(s.path) if s.name is None else "" if s.name == "." else s.name)
                    elif isinstance(s, p.Value):
                        found += [x.name for x in s.names]
                    else:
                        found.append(s.name.name)
            for x in found:
                if x not in ("", "_"):
                    self.bind(x)


def _op(text: str) -> str:
    return f"OP_{OPERATORS.get(text, 'UNK')}"


_RULES = {
    p.Ident: lambda w, n: w.refer(n.name),
    p.Basic: lambda w, n: w.walk(LITERALS.get(n.kind, "LIT_UNK")),
    p.Binary: lambda w, n: w.wrap("BINOP", n.x, _op(n.op), n.y),
    p.Unary: lambda w, n: w.wrap("UNARY", _op(n.op), n.x),
    p.Star: lambda w, n: w.wrap("STAR", n.x),
    p.Paren: lambda w, n: w.walk(n.x),
    p.Selector: lambda w, n: w.wrap("SELECTOR", n.x, lambda: w.field(n.name)),
    p.Index: lambda w, n: w.wrap("INDEX" if len(n.indices) == 1 else "INDEX_LIST", n.x, n.indices),
    p.Slice: lambda w, n: w.wrap("SLICE", n.x, n.bounds),
    p.Assert: lambda w, n: w.wrap("TYPE_ASSERT", n.x, n.type),
    p.Call: lambda w, n: w.wrap("CALL", n.fun, n.args, "ELLIPSIS" if n.spread else None),
    p.KeyValue: lambda w, n: w.wrap("KV", n.key, n.value),
    p.Composite: lambda w, n: w.wrap("COMPOSITE_LIT", n.type, n.elements),
    p.FuncLit: lambda w, n: w.wrap("FUNC_LIT", n.type, n.body, scope=True),
    p.Ellipsis_: lambda w, n: w.wrap("ELLIPSIS_TYPE", n.type),
    p.Array: lambda w, n: w.wrap("ARRAY_TYPE", n.length, n.type),
    p.Map: lambda w, n: w.wrap("MAP_TYPE", n.key, n.value),
    p.Chan: lambda w, n: w.wrap("CHAN_TYPE", f"CHAN_{n.direction}", n.value),
    p.Func: Walk.func_type,
    p.Struct: lambda w, n: w.wrap("STRUCT_TYPE", lambda: w.field_list(n.fields, w.field)),
    p.Interface: lambda w, n: w.wrap("INTERFACE_TYPE", lambda: w.field_list(n.fields, w.field)),
    p.Block: lambda w, n: w.wrap("BLOCK", n.body, scope=True),
    p.Expr: lambda w, n: w.wrap("EXPR_STMT", n.x),
    p.Assign: Walk.assign,
    p.IncDec: lambda w, n: w.wrap("INCDEC", n.x, _op(n.op)),
    p.Return: lambda w, n: w.wrap("RETURN", n.results),
    p.Branch: lambda w, n: w.wrap("BRANCH", BRANCHES.get(n.kind, "BR_UNK"), n.label),
    p.If: lambda w, n: w.wrap("IF", n.init, n.cond, n.body, (lambda: w.wrap("ELSE", n.other)) if n.other is not None else None, scope=True),
    p.For: lambda w, n: w.wrap("FOR", n.init, n.cond, n.post, n.body, scope=True),
    p.Range: Walk.range_,
    p.Switch: lambda w, n: w.wrap("SWITCH", n.init, n.tag, n.body, scope=True),
    p.TypeSwitch: lambda w, n: w.wrap("TYPE_SWITCH", n.init, n.guard, n.body, scope=True),
    p.Case: lambda w, n: w.wrap("CASE", n.values, n.body, scope=True),
    p.Select: lambda w, n: w.wrap("SELECT", n.body, scope=True),
    p.Comm: lambda w, n: w.wrap("COMM_CLAUSE", n.stmt, n.body, scope=True),
    p.Go: lambda w, n: w.wrap("GO", n.call),
    p.Defer: lambda w, n: w.wrap("DEFER", n.call),
    p.Send: lambda w, n: w.wrap("SEND", n.chan, n.value),
    p.Labeled: Walk.labeled,
    p.Empty: lambda w, n: w.walk("EMPTY_STMT"),
    p.Decl: lambda w, n: w.wrap(DECLARATIONS.get(n.keyword, "GEN_DECL"), n.specs),
    p.Import: lambda w, n: None,
    p.Value: lambda w, n: w.wrap("VALUE_SPEC", [(lambda x=x: w.declare(x.name)) for x in n.names], n.type, n.values),
    p.Type: Walk.type_spec,
    p.FuncDecl: Walk.func_decl,
}


def tokens(source: str) -> list[str]:
    """The tokens of a file; SyntaxFault if it is not Go."""
    decls = p.parse(source)
    w = Walk()
    w.package_names(decls)
    w.out.append("BOS")
    for i, d in enumerate(decls):
        if i:
            w.out.append("EOF")
        mark = len(w.names)
        w.walk(d)
        if isinstance(d, p.FuncDecl):
            w.leave(mark)
    w.out.append("EOF")
    return w.out
