import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import vocab
from quarry.functions.golang.scanner import SyntaxFault, scan
from quarry.functions.golang.walk import import_name, tokens
from quarry.operators.tokenize import tokens_or_error
from quarry.plans import constructs

FIXTURES = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
#: The written goldens that come with a source of their own.
GOLDEN = {}
for m in re.finditer(r"### (G\d+).*?(?=\n### |\Z)", FIXTURES, re.S):
    if go := re.search(r"```go\n(.*?)```", m[0], re.S):
        GOLDEN[m[1]] = go[1], re.search(r"```golden\n(.*?)```", m[0], re.S)[1].split()

RING = """package ring

type Ring struct {
	buf  []byte
	head int
}

// Next gives the byte at the head, and moves it on.
func (r *Ring) Next() (b byte) {
	b = r.buf[r.head%len(r.buf)]
	r.head++
	return
}
"""
GOLDEN["ring"] = RING, """
BOS OPEN_TYPE_DECL OPEN_TYPE_SPEC NAME_0 OPEN_STRUCT_TYPE
OPEN_FIELD FIELD_0 OPEN_ARRAY_TYPE T_BYTE CLOSE_ARRAY_TYPE CLOSE_FIELD OPEN_FIELD FIELD_1 T_INT CLOSE_FIELD
CLOSE_STRUCT_TYPE CLOSE_TYPE_SPEC CLOSE_TYPE_DECL EOF
OPEN_FUNC_DECL OPEN_RECV OPEN_FIELD NAME_1 OPEN_STAR NAME_0 CLOSE_STAR CLOSE_FIELD CLOSE_RECV FIELD_2
OPEN_FUNC_TYPE OPEN_PARAMS CLOSE_PARAMS OPEN_RESULTS OPEN_FIELD NAME_2 T_BYTE CLOSE_FIELD CLOSE_RESULTS CLOSE_FUNC_TYPE
OPEN_BLOCK OPEN_ASSIGN NAME_2 OP_ASSIGN OPEN_INDEX OPEN_SELECTOR NAME_1 FIELD_0 CLOSE_SELECTOR
OPEN_BINOP OPEN_SELECTOR NAME_1 FIELD_1 CLOSE_SELECTOR OP_REM OPEN_CALL BI_LEN OPEN_SELECTOR NAME_1 FIELD_0 CLOSE_SELECTOR CLOSE_CALL CLOSE_BINOP CLOSE_INDEX CLOSE_ASSIGN
OPEN_INCDEC OPEN_SELECTOR NAME_1 FIELD_1 CLOSE_SELECTOR OP_INC CLOSE_INCDEC OPEN_RETURN CLOSE_RETURN CLOSE_BLOCK CLOSE_FUNC_DECL EOF
""".split()
GOLDEN["nothing"] = "package p", ["BOS", "EOF"]


def balanced(stream):
    """Whether the ids of brackets cancel out, each opening with its closing as the vocabulary pairs them."""
    open_ = []
    for i in map(vocab.IDS.get, stream):
        if i in vocab.CLOSES:
            open_.append(i)
        elif open_ and vocab.CLOSES[open_[-1]] == i:
            del open_[-1]
        elif i in vocab.CLOSES.values():
            return False
    return open_ == []


def body(stream):
    """The tokens of the first function's block, without its brackets."""
    at = stream.index("OPEN_BLOCK")
    return " ".join(stream[at + 1 : len(stream) - stream[::-1].index("CLOSE_BLOCK") - 1])


def in_func(statements, params=""):
    return body(tokens(f"package p\nfunc f({params}) {{\n{statements}\n}}\n"))


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(name):
    source, want = GOLDEN[name]
    assert tokens(source) == want


@pytest.mark.parametrize(("source", "want"), constructs.files())
def test_construct(source, want):
    got = tokens(source)
    assert " ".join(got) == want and balanced(got)


def test_constructs_reach_the_vocabulary():
    """All that the walk can give, but for marks of kinds that no parsed file has."""
    given = {t for _, want in constructs.files() for t in want.split()}
    given |= {f"{kind}_{k}" for kind in ("NAME", "FIELD") for k in range(64)}
    assert set(vocab.TOKENS) - given == {"PAD", "LIT_UNK", "BR_UNK", "NAME_OVF"}


REFUSED = """
x := 1|func f() { if x { }|var x|const a|func f() { x = }|var s = "abc|func f(a int, string) {}|func f() { go x }|var x = 08|var x = 'ab'|/* open
func f() { if T{1} == x {} }|var a int; import "x"|import ""|func f() { for { } } }|func (t T) m[X any]() {}|var x = a[1:2:]|var x = 1__0|var x = "\\q"
func f() { a b }|#|var x = 0x|var x = 0x1.0|func f() { if { } }|func f() { for i := 0; i < 2 { } }|func f() { switch x = y.(type) { } }|type T[P any, Q] int x
func f() { x, y }|var x = 'a|func f() { return 1 2 }|type S struct { a, b }|func f() { case 1: }|var x = "\\400"|func f() { select { case x++: } }
""".strip().replace("\n", "|").split("|")


@pytest.mark.parametrize("declaration", REFUSED)
def test_refused(declaration):
    with pytest.raises(SyntaxFault):
        tokens(f"package p\n{declaration}\n")


@pytest.mark.parametrize("source", ["", "package", "package _", "func f() {}"])
def test_no_file(source):
    with pytest.raises(SyntaxFault):
        tokens(source)


def test_numbers_and_strings():
    kinds = [k for k, _, _ in scan("1 0x_1F 0b1 0o7 017 1_000 1.5 .5 1e3 0x1p-2 08.5 1i 09i 'a' '\\n' '\\u00e9' \"\" `a\nb` \"\\x41\"")][:-2]
    assert kinds == ["INT"] * 6 + ["FLOAT"] * 5 + ["IMAG"] * 2 + ["CHAR"] * 3 + ["STRING"] * 3


def test_overflow():
    names = in_func("\n".join("x := 1" for _ in range(70)))
    assert "NAME_63" in names and names.count("NAME_OVF") == 7
    fields = in_func("\n".join(f"_ = a.f{k}" for k in range(66)), "a int")
    assert "FIELD_63" in fields and fields.count("FIELD_OVF") == 2


@pytest.mark.parametrize(("path", "name"), [('"fmt"', "fmt"), ('"net/http"', "http"), ('"a/b/v2"', "b"), ('"v2"', "v2"), ('"a/v3/v2"', "a"), ('"gopkg.in/yaml.v3"', "yaml.v3"), ("`x/y`", "y")])
def test_import_name(path, name):
    assert import_name(path) == name


def test_vocabulary():
    assert len(vocab.TOKENS) == 329
    assert [vocab.IDS[t] for t in ("BOS", "EOF", "PAD", "OPEN_FUNC_DECL", "CLOSE_FUNC_LIT", "NAME_0", "FIELD_0", "FIELD_63")] == [0, 1, 2, 101, 200, 201, 265, 328]


def test_errors_say_where():
    assert tokens_or_error("package p\nfunc f( {\n")[1].startswith("2:9: ")
    assert tokens_or_error(b"package p\nvar s = \"\xff\"\n")[1].startswith("illegal UTF-8")
    assert tokens_or_error(None) == (None, "no content")


# Programs made at random, printed and read again.
names = st.sampled_from(["a", "b", "x", "y2", "_", "len", "T", "é"])
atoms = names | st.sampled_from(["1", "2.5", "'c'", '"s"', "nil", "3i", "`r`", "a.b", "pkg.Q"])
expressions = st.recursive(
    atoms,
    lambda e: st.one_of(
        st.tuples(e, st.sampled_from("+ - * / && || == < << &^".split()), e).map(" ".join), e.map(lambda x: f"({x})"), e.map(lambda x: f"-({x})"), e.map(lambda x: f"f({x}, {x})"),
        st.tuples(names, e).map(lambda p: f"{p[0]}[{p[1]}]"), e.map(lambda x: f"[]int{{{x}}}"), e.map(lambda x: f"func(z int) int {{ return {x} }}"), e.map(lambda x: f"(&T{{k: {x}}})"), names.map(lambda x: f"{x}[1:]"),
    ),
    max_leaves=6,
)
simple = st.one_of(st.tuples(names, st.sampled_from(["=", ":=", "+="]), expressions).map(" ".join), names.map(lambda x: f"{x}++"), expressions.map(lambda x: f"f({x})"), expressions.map(lambda x: f"return {x}"), expressions.map(lambda x: f"var v, w = {x}, 1"))
statements = st.recursive(
    simple,
    lambda s: st.one_of(
        s.map(lambda x: f"if (a) {{\n{x}\n}} else {{\n{x}\n}}"), s.map(lambda x: f"for i := 0; i < 3; i++ {{\n{x}\n}}"), s.map(lambda x: f"for k, v := range m {{\n{x}\n}}"),
        s.map(lambda x: f"switch a {{\ncase 1, 2:\n{x}\ndefault:\n}}"), s.map(lambda x: f"{{\n{x}\n}}"), st.tuples(s, s).map("\n".join), s.map(lambda x: f"go func() {{\n{x}\n}}()"), s.map(lambda x: f"L:\n{x}"),
    ),
    max_leaves=6,
)


@settings(max_examples=150, deadline=None)
@given(st.lists(statements, max_size=3), st.lists(names, max_size=3))
def test_programs(stmts, params):
    listed = ", ".join(f"{p} int" for p in params)
    source = "package p\nimport \"m\"\n" + "".join(f"func f{k}({listed}) {{\n{s}\n}}\n" for k, s in enumerate(stmts))
    got = tokens(source)
    assert balanced(got) and got == tokens(source) and not set(got) - set(vocab.IDS)
    assert got[0] == "BOS" and got[-1] == "EOF" and got.count("EOF") == len(stmts) + 1
