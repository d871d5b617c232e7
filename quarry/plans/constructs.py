"""Go constructs and the tokens that each must give, worked out by hand from the scheme: what the
query ``go_constructs`` and the tests hold the tokenizer against. Nothing here calls it."""

from __future__ import annotations

#: A statement in a function f(a, b int), and its tokens: f is slot 0, a 1, b 2.
STATEMENTS = {
    "a = a + b*2": "OPEN_ASSIGN NAME_1 OP_ASSIGN OPEN_BINOP NAME_1 OP_ADD OPEN_BINOP NAME_2 OP_MUL INT_LIT CLOSE_BINOP CLOSE_BINOP CLOSE_ASSIGN",
    "a <<= -b": "OPEN_ASSIGN NAME_1 OP_SHL_ASSIGN OPEN_UNARY OP_SUB NAME_2 CLOSE_UNARY CLOSE_ASSIGN",
    "_ = (a)": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN NAME_1 CLOSE_ASSIGN",
    "_ = a[1:2:3]": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_SLICE NAME_1 INT_LIT INT_LIT INT_LIT CLOSE_SLICE CLOSE_ASSIGN",
    "_ = a[:1]": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_SLICE NAME_1 INT_LIT CLOSE_SLICE CLOSE_ASSIGN",
    "_ = a[int, string]": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_INDEX_LIST NAME_1 T_INT T_STRING CLOSE_INDEX_LIST CLOSE_ASSIGN",
    "_ = a.(T)": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_TYPE_ASSERT NAME_1 NAME_UNK CLOSE_TYPE_ASSERT CLOSE_ASSIGN",
    "print(a, b...)": "OPEN_EXPR_STMT OPEN_CALL BI_PRINT NAME_1 NAME_2 ELLIPSIS CLOSE_CALL CLOSE_EXPR_STMT",
    "_ = [...]int{1: 2}": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_COMPOSITE_LIT OPEN_ARRAY_TYPE OPEN_ELLIPSIS_TYPE CLOSE_ELLIPSIS_TYPE T_INT CLOSE_ARRAY_TYPE OPEN_KV INT_LIT INT_LIT CLOSE_KV CLOSE_COMPOSITE_LIT CLOSE_ASSIGN",
    "_ = map[string][]byte{}": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_COMPOSITE_LIT OPEN_MAP_TYPE T_STRING OPEN_ARRAY_TYPE T_BYTE CLOSE_ARRAY_TYPE CLOSE_MAP_TYPE CLOSE_COMPOSITE_LIT CLOSE_ASSIGN",
    "go func(x int) { _ = x }(a)": "OPEN_GO OPEN_CALL OPEN_FUNC_LIT OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_3 T_INT CLOSE_FIELD CLOSE_PARAMS CLOSE_FUNC_TYPE OPEN_BLOCK OPEN_ASSIGN NAME_BLANK OP_ASSIGN NAME_3 CLOSE_ASSIGN CLOSE_BLOCK CLOSE_FUNC_LIT NAME_1 CLOSE_CALL CLOSE_GO",
    "defer a.b()": "OPEN_DEFER OPEN_CALL OPEN_SELECTOR NAME_1 FIELD_0 CLOSE_SELECTOR CLOSE_CALL CLOSE_DEFER",
    "a <- 'x'": "OPEN_SEND NAME_1 CHAR_LIT CLOSE_SEND",
    "_ = <-a": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_UNARY OP_ARROW NAME_1 CLOSE_UNARY CLOSE_ASSIGN",
    "var c <-chan chan<- int": "OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_3 OPEN_CHAN_TYPE CHAN_RECV OPEN_CHAN_TYPE CHAN_SEND T_INT CLOSE_CHAN_TYPE CLOSE_CHAN_TYPE CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
    "_ = <-chan int(nil)": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_UNARY OP_ARROW OPEN_CALL OPEN_CHAN_TYPE CHAN_BI T_INT CLOSE_CHAN_TYPE BI_NIL CLOSE_CALL CLOSE_UNARY CLOSE_ASSIGN",
    "const c = 1.5i": "OPEN_CONST_DECL OPEN_VALUE_SPEC NAME_3 IMAG_LIT CLOSE_VALUE_SPEC CLOSE_CONST_DECL",
    "type T = struct{ A, B int; *C }": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_3 OPEN_STRUCT_TYPE OPEN_FIELD FIELD_0 FIELD_1 T_INT CLOSE_FIELD OPEN_FIELD OPEN_STAR NAME_UNK CLOSE_STAR CLOSE_FIELD CLOSE_STRUCT_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL",
    "var i interface{ ~int | string; M(x int) }": "OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_3 OPEN_INTERFACE_TYPE OPEN_FIELD OPEN_BINOP OPEN_UNARY OP_UNK T_INT CLOSE_UNARY OP_OR T_STRING CLOSE_BINOP CLOSE_FIELD OPEN_FIELD FIELD_0 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_4 T_INT CLOSE_FIELD CLOSE_PARAMS CLOSE_FUNC_TYPE CLOSE_FIELD CLOSE_INTERFACE_TYPE CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
    "if x := a; x > b { return } else if b == 0 { } else { a++ }": "OPEN_IF OPEN_ASSIGN NAME_3 OP_DEFINE NAME_1 CLOSE_ASSIGN OPEN_BINOP NAME_3 OP_GTR NAME_2 CLOSE_BINOP OPEN_BLOCK OPEN_RETURN CLOSE_RETURN CLOSE_BLOCK OPEN_ELSE OPEN_IF OPEN_BINOP NAME_2 OP_EQL INT_LIT CLOSE_BINOP OPEN_BLOCK CLOSE_BLOCK OPEN_ELSE OPEN_BLOCK OPEN_INCDEC NAME_1 OP_INC CLOSE_INCDEC CLOSE_BLOCK CLOSE_ELSE CLOSE_IF CLOSE_ELSE CLOSE_IF",
    "for i := 0; i < b; i++ { continue }": "OPEN_FOR OPEN_ASSIGN NAME_3 OP_DEFINE INT_LIT CLOSE_ASSIGN OPEN_BINOP NAME_3 OP_LSS NAME_2 CLOSE_BINOP OPEN_INCDEC NAME_3 OP_INC CLOSE_INCDEC OPEN_BLOCK OPEN_BRANCH BR_CONTINUE CLOSE_BRANCH CLOSE_BLOCK CLOSE_FOR",
    "for range a { }": "OPEN_RANGE NAME_1 OPEN_BLOCK CLOSE_BLOCK CLOSE_RANGE",
    "for a, b = range b { }": "OPEN_RANGE NAME_1 NAME_2 NAME_2 OPEN_BLOCK CLOSE_BLOCK CLOSE_RANGE",
    "switch x := a.(type) { case int, nil: default: }": "OPEN_TYPE_SWITCH OPEN_ASSIGN NAME_3 OP_DEFINE OPEN_TYPE_ASSERT NAME_1 CLOSE_TYPE_ASSERT CLOSE_ASSIGN OPEN_BLOCK OPEN_CASE T_INT BI_NIL CLOSE_CASE OPEN_CASE CLOSE_CASE CLOSE_BLOCK CLOSE_TYPE_SWITCH",
    "switch { case a > b: fallthrough; case true: }": "OPEN_SWITCH OPEN_BLOCK OPEN_CASE OPEN_BINOP NAME_1 OP_GTR NAME_2 CLOSE_BINOP OPEN_BRANCH BR_FALLTHROUGH CLOSE_BRANCH CLOSE_CASE OPEN_CASE BI_TRUE CLOSE_CASE CLOSE_BLOCK CLOSE_SWITCH",
    "select { case v := <-a: _ = v; case a <- 1: default: }": "OPEN_SELECT OPEN_BLOCK OPEN_COMM_CLAUSE OPEN_ASSIGN NAME_3 OP_DEFINE OPEN_UNARY OP_ARROW NAME_1 CLOSE_UNARY CLOSE_ASSIGN OPEN_ASSIGN NAME_BLANK OP_ASSIGN NAME_3 CLOSE_ASSIGN CLOSE_COMM_CLAUSE OPEN_COMM_CLAUSE OPEN_SEND NAME_1 INT_LIT CLOSE_SEND CLOSE_COMM_CLAUSE OPEN_COMM_CLAUSE CLOSE_COMM_CLAUSE CLOSE_BLOCK CLOSE_SELECT",
    "goto end; end:": "OPEN_BRANCH BR_GOTO NAME_UNK CLOSE_BRANCH OPEN_LABELED NAME_3 EMPTY_STMT CLOSE_LABELED",
    "loop: for { break loop }": "OPEN_LABELED NAME_3 OPEN_FOR OPEN_BLOCK OPEN_BRANCH BR_BREAK NAME_3 CLOSE_BRANCH CLOSE_BLOCK CLOSE_FOR CLOSE_LABELED",
    ";": "EMPTY_STMT",
    "{ x := 1; _ = x }; y := 2": "OPEN_BLOCK OPEN_ASSIGN NAME_3 OP_DEFINE INT_LIT CLOSE_ASSIGN OPEN_ASSIGN NAME_BLANK OP_ASSIGN NAME_3 CLOSE_ASSIGN CLOSE_BLOCK OPEN_ASSIGN NAME_3 OP_DEFINE INT_LIT CLOSE_ASSIGN",
    "if f(T{1}) { }": "OPEN_IF OPEN_CALL NAME_0 OPEN_COMPOSITE_LIT NAME_UNK INT_LIT CLOSE_COMPOSITE_LIT CLOSE_CALL OPEN_BLOCK CLOSE_BLOCK CLOSE_IF",
    "_ = [][]int{{1}, {2}}": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_COMPOSITE_LIT OPEN_ARRAY_TYPE OPEN_ARRAY_TYPE T_INT CLOSE_ARRAY_TYPE CLOSE_ARRAY_TYPE OPEN_COMPOSITE_LIT INT_LIT CLOSE_COMPOSITE_LIT OPEN_COMPOSITE_LIT INT_LIT CLOSE_COMPOSITE_LIT CLOSE_COMPOSITE_LIT CLOSE_ASSIGN",
    "x := a; { x := b; _ = x }; _ = x": "OPEN_ASSIGN NAME_3 OP_DEFINE NAME_1 CLOSE_ASSIGN OPEN_BLOCK OPEN_ASSIGN NAME_4 OP_DEFINE NAME_2 CLOSE_ASSIGN OPEN_ASSIGN NAME_BLANK OP_ASSIGN NAME_4 CLOSE_ASSIGN CLOSE_BLOCK OPEN_ASSIGN NAME_BLANK OP_ASSIGN NAME_3 CLOSE_ASSIGN",
    "_ = *a": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_STAR NAME_1 CLOSE_STAR CLOSE_ASSIGN",
    "_ = a.c.d.c": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_SELECTOR OPEN_SELECTOR OPEN_SELECTOR NAME_1 FIELD_0 CLOSE_SELECTOR FIELD_1 CLOSE_SELECTOR FIELD_0 CLOSE_SELECTOR CLOSE_ASSIGN",
    "_ = a[b]": "OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_INDEX NAME_1 NAME_2 CLOSE_INDEX CLOSE_ASSIGN",
    "var x, y = a, b": "OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_3 NAME_4 NAME_1 NAME_2 CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
    "var a = b": "OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_1 NAME_2 CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
    "return a, b": "OPEN_RETURN NAME_1 NAME_2 CLOSE_RETURN",
    "for { }": "OPEN_FOR OPEN_BLOCK CLOSE_BLOCK CLOSE_FOR",
    "for a < b { break }": "OPEN_FOR OPEN_BINOP NAME_1 OP_LSS NAME_2 CLOSE_BINOP OPEN_BLOCK OPEN_BRANCH BR_BREAK CLOSE_BRANCH CLOSE_BLOCK CLOSE_FOR",
    "for k, v := range a { _ = v }": "OPEN_RANGE NAME_3 NAME_4 NAME_1 OPEN_BLOCK OPEN_ASSIGN NAME_BLANK OP_ASSIGN NAME_4 CLOSE_ASSIGN CLOSE_BLOCK CLOSE_RANGE",
    "switch c := a; c { case 1: print(c); default: }": "OPEN_SWITCH OPEN_ASSIGN NAME_3 OP_DEFINE NAME_1 CLOSE_ASSIGN NAME_3 OPEN_BLOCK OPEN_CASE INT_LIT OPEN_EXPR_STMT OPEN_CALL BI_PRINT NAME_3 CLOSE_CALL CLOSE_EXPR_STMT CLOSE_CASE OPEN_CASE CLOSE_CASE CLOSE_BLOCK CLOSE_SWITCH",
    "switch a.(type) { }": "OPEN_TYPE_SWITCH OPEN_EXPR_STMT OPEN_TYPE_ASSERT NAME_1 CLOSE_TYPE_ASSERT CLOSE_EXPR_STMT OPEN_BLOCK CLOSE_BLOCK CLOSE_TYPE_SWITCH",
    "again: goto again": "OPEN_LABELED NAME_3 OPEN_BRANCH BR_GOTO NAME_3 CLOSE_BRANCH CLOSE_LABELED",
    "var h func(c int, d ...string) (e error)": "OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_3 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_4 T_INT CLOSE_FIELD OPEN_FIELD NAME_5 OPEN_ELLIPSIS_TYPE T_STRING CLOSE_ELLIPSIS_TYPE CLOSE_FIELD CLOSE_PARAMS OPEN_RESULTS OPEN_FIELD NAME_6 T_ERROR CLOSE_FIELD CLOSE_RESULTS CLOSE_FUNC_TYPE CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
}

#: Declarations behind ``package p``, and their tokens between BOS and the last EOF.
DECLARATIONS = {
    "func F[T any, K comparable](x T, _ ...K) (n int, err error)": "OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_TYPE_PARAMS OPEN_FIELD NAME_1 T_ANY CLOSE_FIELD OPEN_FIELD NAME_2 T_COMPARABLE CLOSE_FIELD CLOSE_TYPE_PARAMS OPEN_PARAMS OPEN_FIELD NAME_3 NAME_1 CLOSE_FIELD OPEN_FIELD NAME_BLANK OPEN_ELLIPSIS_TYPE NAME_2 CLOSE_ELLIPSIS_TYPE CLOSE_FIELD CLOSE_PARAMS OPEN_RESULTS OPEN_FIELD NAME_4 T_INT CLOSE_FIELD OPEN_FIELD NAME_5 T_ERROR CLOSE_FIELD CLOSE_RESULTS CLOSE_FUNC_TYPE CLOSE_FUNC_DECL",
    "func f(int, T)": "OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD T_INT CLOSE_FIELD OPEN_FIELD NAME_UNK CLOSE_FIELD CLOSE_PARAMS CLOSE_FUNC_TYPE CLOSE_FUNC_DECL",
    "func f(a, b []int, c [3]T)": "OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_1 NAME_2 OPEN_ARRAY_TYPE T_INT CLOSE_ARRAY_TYPE CLOSE_FIELD OPEN_FIELD NAME_3 OPEN_ARRAY_TYPE INT_LIT NAME_UNK CLOSE_ARRAY_TYPE CLOSE_FIELD CLOSE_PARAMS CLOSE_FUNC_TYPE CLOSE_FUNC_DECL",
    "func f(T[int])": "OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD OPEN_INDEX NAME_UNK T_INT CLOSE_INDEX CLOSE_FIELD CLOSE_PARAMS CLOSE_FUNC_TYPE CLOSE_FUNC_DECL",
    "type A [N]int": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_ARRAY_TYPE NAME_UNK T_INT CLOSE_ARRAY_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL",
    "type A [N * 2]int": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_ARRAY_TYPE OPEN_BINOP NAME_UNK OP_MUL INT_LIT CLOSE_BINOP T_INT CLOSE_ARRAY_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL",
    "type A [P *T,] int": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_FIELD NAME_1 OPEN_STAR NAME_UNK CLOSE_STAR CLOSE_FIELD T_INT CLOSE_TYPE_SPEC CLOSE_TYPE_DECL",
    "type A [P interface{ ~int }] []P": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_FIELD NAME_1 OPEN_INTERFACE_TYPE OPEN_FIELD OPEN_UNARY OP_UNK T_INT CLOSE_UNARY CLOSE_FIELD CLOSE_INTERFACE_TYPE CLOSE_FIELD OPEN_ARRAY_TYPE NAME_1 CLOSE_ARRAY_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL",
    "type A [P ~int | ~string] struct{}": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_FIELD NAME_1 OPEN_BINOP OPEN_UNARY OP_UNK T_INT CLOSE_UNARY OP_OR OPEN_UNARY OP_UNK T_STRING CLOSE_UNARY CLOSE_BINOP CLOSE_FIELD OPEN_STRUCT_TYPE CLOSE_STRUCT_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL",
    'import ("a"; b "c/d"; . "e"; _ "f")': "OPEN_GEN_DECL CLOSE_GEN_DECL",
    "const (a = iota; b)": "OPEN_CONST_DECL OPEN_VALUE_SPEC NAME_0 BI_IOTA CLOSE_VALUE_SPEC OPEN_VALUE_SPEC NAME_1 CLOSE_VALUE_SPEC CLOSE_CONST_DECL",
    "var f = func(a int) func() { return nil }": "OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_0 OPEN_FUNC_LIT OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_1 T_INT CLOSE_FIELD CLOSE_PARAMS OPEN_RESULTS OPEN_FIELD OPEN_FUNC_TYPE OPEN_PARAMS CLOSE_PARAMS CLOSE_FUNC_TYPE CLOSE_FIELD CLOSE_RESULTS CLOSE_FUNC_TYPE OPEN_BLOCK OPEN_RETURN BI_NIL CLOSE_RETURN CLOSE_BLOCK CLOSE_FUNC_LIT CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
    "func f(len int) { _ = len }": "OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_1 T_INT CLOSE_FIELD CLOSE_PARAMS CLOSE_FUNC_TYPE OPEN_BLOCK OPEN_ASSIGN NAME_BLANK OP_ASSIGN BI_LEN CLOSE_ASSIGN CLOSE_BLOCK CLOSE_FUNC_DECL",
    'import m "a/b"; import . "c"; import _ "d"; var v = m.F': "OPEN_GEN_DECL CLOSE_GEN_DECL EOF OPEN_GEN_DECL CLOSE_GEN_DECL EOF OPEN_GEN_DECL CLOSE_GEN_DECL EOF OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_1 OPEN_SELECTOR NAME_0 FIELD_0 CLOSE_SELECTOR CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
    'import ("a/b/v2"; `c/v3/v4`); var v = b.F + c.F': "OPEN_GEN_DECL CLOSE_GEN_DECL EOF OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_2 OPEN_BINOP OPEN_SELECTOR NAME_0 FIELD_0 CLOSE_SELECTOR OP_ADD OPEN_SELECTOR NAME_1 FIELD_0 CLOSE_SELECTOR CLOSE_BINOP CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
    "func init() { }; func init() { }": "OPEN_FUNC_DECL NAME_1 OPEN_FUNC_TYPE OPEN_PARAMS CLOSE_PARAMS CLOSE_FUNC_TYPE OPEN_BLOCK CLOSE_BLOCK CLOSE_FUNC_DECL EOF OPEN_FUNC_DECL NAME_1 OPEN_FUNC_TYPE OPEN_PARAMS CLOSE_PARAMS CLOSE_FUNC_TYPE OPEN_BLOCK CLOSE_BLOCK CLOSE_FUNC_DECL",
    "type S struct{ v int }; func (s S) Get() int { return s.v }": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_STRUCT_TYPE OPEN_FIELD FIELD_0 T_INT CLOSE_FIELD CLOSE_STRUCT_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL EOF OPEN_FUNC_DECL OPEN_RECV OPEN_FIELD NAME_1 NAME_0 CLOSE_FIELD CLOSE_RECV FIELD_1 OPEN_FUNC_TYPE OPEN_PARAMS CLOSE_PARAMS OPEN_RESULTS OPEN_FIELD T_INT CLOSE_FIELD CLOSE_RESULTS CLOSE_FUNC_TYPE OPEN_BLOCK OPEN_RETURN OPEN_SELECTOR NAME_1 FIELD_0 CLOSE_SELECTOR CLOSE_RETURN CLOSE_BLOCK CLOSE_FUNC_DECL",
    "type (A int; B = A); const _ = 1": "OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 T_INT CLOSE_TYPE_SPEC OPEN_TYPE_SPEC NAME_1 NAME_0 CLOSE_TYPE_SPEC CLOSE_TYPE_DECL EOF OPEN_CONST_DECL OPEN_VALUE_SPEC NAME_BLANK INT_LIT CLOSE_VALUE_SPEC CLOSE_CONST_DECL",
    "func g(); var _ = g": "OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS CLOSE_PARAMS CLOSE_FUNC_TYPE CLOSE_FUNC_DECL EOF OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_BLANK NAME_0 CLOSE_VALUE_SPEC CLOSE_VAR_DECL",
}

# Names and symbols, each with the token it has.
PREDECLARED = """
len BI_LEN, cap BI_CAP, panic BI_PANIC, recover BI_RECOVER, make BI_MAKE, new BI_NEW, append BI_APPEND, copy BI_COPY, delete BI_DELETE, close BI_CLOSE,
complex BI_COMPLEX, real BI_REAL, imag BI_IMAG, print BI_PRINT, println BI_PRINTLN, nil BI_NIL, true BI_TRUE, false BI_FALSE, iota BI_IOTA,
bool T_BOOL, byte T_BYTE, rune T_RUNE, string T_STRING, int T_INT, int8 T_INT8, int16 T_INT16, int32 T_INT32, int64 T_INT64, uint T_UINT, uint8 T_UINT8,
uint16 T_UINT16, uint32 T_UINT32, uint64 T_UINT64, uintptr T_UINTPTR, float32 T_FLOAT32, float64 T_FLOAT64, complex64 T_COMPLEX64, complex128 T_COMPLEX128,
error T_ERROR, any T_ANY, comparable T_COMPARABLE
"""
BINARY = "+ OP_ADD, - OP_SUB, * OP_MUL, / OP_QUO, % OP_REM, & OP_AND, | OP_OR, ^ OP_XOR, << OP_SHL, >> OP_SHR, &^ OP_ANDNOT, && OP_LAND, || OP_LOR, == OP_EQL, != OP_NEQ, < OP_LSS, > OP_GTR, <= OP_LEQ, >= OP_GEQ"
UNARY = "+ OP_ADD, - OP_SUB, ! OP_NOT, ^ OP_XOR, & OP_AND, <- OP_ARROW"
ASSIGNING = "= OP_ASSIGN, += OP_ADD_ASSIGN, -= OP_SUB_ASSIGN, *= OP_MUL_ASSIGN, /= OP_QUO_ASSIGN, %= OP_REM_ASSIGN, &= OP_AND_ASSIGN, |= OP_OR_ASSIGN, ^= OP_XOR_ASSIGN, <<= OP_SHL_ASSIGN, >>= OP_SHR_ASSIGN, &^= OP_ANDNOT_ASSIGN"
STEPPING = "++ OP_INC, -- OP_DEC"
LITERALS = "1 INT_LIT, 0x1F INT_LIT, 1.5 FLOAT_LIT, 2i IMAG_LIT, 'c' CHAR_LIT, \"s\" STRING_LIT, `r` STRING_LIT"
CHANNELS = "chan CHAN_BI, chan<- CHAN_SEND, <-chan CHAN_RECV"
BRANCHES = "break BR_BREAK, continue BR_CONTINUE, goto BR_GOTO, fallthrough BR_FALLTHROUGH"


def _pairs(listed: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in listed.replace("\n", " ").split(",")]


def by_rule() -> dict[str, str]:
    """Statements that differ in one name or symbol each, in the same function."""
    out = {f"_ = {x}": f"OPEN_ASSIGN NAME_BLANK OP_ASSIGN {t} CLOSE_ASSIGN" for x, t in _pairs(PREDECLARED) + _pairs(LITERALS)}
    out |= {f"_ = a {x} b": f"OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_BINOP NAME_1 {t} NAME_2 CLOSE_BINOP CLOSE_ASSIGN" for x, t in _pairs(BINARY)}
    out |= {f"_ = {x}a": f"OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_UNARY {t} NAME_1 CLOSE_UNARY CLOSE_ASSIGN" for x, t in _pairs(UNARY)}
    out |= {f"a {x} b": f"OPEN_ASSIGN NAME_1 {t} NAME_2 CLOSE_ASSIGN" for x, t in _pairs(ASSIGNING)}
    out |= {f"a{x}": f"OPEN_INCDEC NAME_1 {t} CLOSE_INCDEC" for x, t in _pairs(STEPPING)}
    out |= {f"var c {x} int": f"OPEN_VAR_DECL OPEN_VALUE_SPEC NAME_3 OPEN_CHAN_TYPE {t} T_INT CLOSE_CHAN_TYPE CLOSE_VALUE_SPEC CLOSE_VAR_DECL" for x, t in _pairs(CHANNELS)}
    out |= {x: f"OPEN_BRANCH {t} CLOSE_BRANCH" for x, t in _pairs(BRANCHES)}
    fields = [f"FIELD_{k}" if k < 64 else "FIELD_OVF" for k in range(66)]
    out["; ".join(f"_ = a.f{k}" for k in range(66))] = " ".join(f"OPEN_ASSIGN NAME_BLANK OP_ASSIGN OPEN_SELECTOR NAME_1 {f} CLOSE_SELECTOR CLOSE_ASSIGN" for f in fields)
    return out


def files() -> list[tuple[str, str]]:
    """(source, tokens) of a file for each construct."""
    head = "BOS OPEN_FUNC_DECL NAME_0 OPEN_FUNC_TYPE OPEN_PARAMS OPEN_FIELD NAME_1 NAME_2 T_INT CLOSE_FIELD CLOSE_PARAMS CLOSE_FUNC_TYPE OPEN_BLOCK"
    inside = [(f"package p\nfunc f(a, b int) {{\n{s}\n}}\n", f"{head} {t} CLOSE_BLOCK CLOSE_FUNC_DECL EOF") for s, t in (STATEMENTS | by_rule()).items()]
    return inside + [(f"package p\n{s}\n", f"BOS {t} EOF") for s, t in DECLARATIONS.items()]
