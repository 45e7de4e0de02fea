"""The scanner of Go files."""

import pytest

from resemblage.sources.golang import functions

SOURCE = '''// Package comment.
package shop

import (
	"fmt"
	str "strings"
)

const limit = len("x(") // call in a constant

type T struct{ f func(int) string }

// Plain does things.
//
// More.
//go:noinline
func Plain(a int, b string) (int, error) {
	defer cleanup()
	go run(a)
	for i := 0; i < 3; i++ {
		if ok(i) {
			return len(b), fmt.Errorf("no(%s)", b) // skipped(1)
		}
	}
	f := func(x int) int { return inner(x) }
	s := `raw(1)
raw2(2)`
	_ = []byte(s)
	_ = map[string]int(nil)
	x.y.z()
	g().h()
	a[0].k()
	v.(T).w()
	Generic[int](f)
	(fn)(1)
	var m interface{ Method(int) }
	_ = *Deref(p)
	switch (a) {
	case 1:
	}
	return 0, nil
}

/* Block
comment. */
func (s *Server) Start() { s.listen() }

func (List[T]) Len() int { return 0 }

func (l *Pair[K, V]) swap(k K, v V) (b V, a K)

func external(x int) int

func last() (r struct{ a int }) {
	return
}
'''


def test_a_file():
    found = {f.name: f for f in functions(SOURCE)}
    assert list(found) == ["Plain", "*Server.Start", "List[T].Len", "*Pair[K, V].swap", "external", "last"]
    plain = found["Plain"]
    assert plain.callees == sorted(["cleanup", "run", "ok", "len", "fmt.Errorf", "inner", "z", "g", "h", "k", "w", "Deref"])
    assert plain.start_line == 17 and SOURCE.split("\n")[16].startswith("func Plain")
    assert plain.doc_comment == "Plain does things.\n\nMore."
    assert plain.signature == "(a int, b string) (int, error)" and plain.exported and plain.package == "shop"
    assert plain.body.startswith("func Plain(") and plain.body.endswith("return 0, nil\n}")
    start = found["*Server.Start"]
    assert (start.receiver_type, start.callees, start.doc_comment, start.exported) == ("*Server", ["s.listen"], " Block\ncomment.", True) or start.doc_comment.strip() == "Block\ncomment."
    assert found["List[T].Len"].receiver_type == "List[T]" and found["List[T].Len"].signature == "() (int)"
    assert found["*Pair[K, V].swap"].body == "func (l *Pair[K, V]) swap(k K, v V) (b V, a K)" and not found["*Pair[K, V].swap"].exported
    assert found["external"].callees == [] and found["last"].callees == []


def test_a_line_end_ends_a_call():
    assert functions("package p\nfunc f() {\n\tx\n\t(y)()\n}\n")[0].callees == []


@pytest.mark.parametrize("source", ["", "func f() {}", "package p\nfunc f() {", "package p\nfunc f( {}\n", 'package p\nvar s = "open\n', "package p\nfunc () {}\n", "package p\nreturn 1\n", "package p\n/* open", "package p\nfunc f() {} func g() {}\n", "package p\nfunc f() {)}\n", "package p\nx := 1\n"])
def test_malformed_files_give_nothing(source):
    assert functions(source) == []


def test_line_directives_move_lines():
    assert functions("package p\n//line gen.go:100\nfunc f() {}\n")[0].start_line == 100


def test_trailing_comments_are_no_documentation():
    assert functions("package p\nvar x = 1 // about x\nfunc f() {}\n")[0].doc_comment == ""


def test_trailing_comments_above_long_functions():
    body = "\tx = x + 1\n" * 2000
    got = functions(f"package p\nvar x = 1 // note\nfunc F() {{\n{body}}}\n// G does.\nfunc G() {{\n{body}}}\n")
    assert [f.doc_comment.strip() for f in got] == ["", "G does."]


def test_unicode_names_and_literals():
    found = functions("package p\nfunc Ünï(r rune) bool { return r == '(' || r == '\\'' || is('\\u00e9', 0x1p-2, 1e+3, .5) }\n")[0]
    assert found.exported and found.callees == ["is"]


STATEMENTS = [
    "x := []int{1, 2, 3}", "m := map[string][]T{\"a\": {1, 2}, \"b\": {}}", "p := &T{A: 1, B: T2{2}}", "if v, ok := m[\"a\"]; ok && v.x() {\n}", "if (T{1}) == t {\n} else if x {\n} else {\n}", "for {\n\tbreak\n}", "for i := 0; i < 3; i++ {\n}", "for ; x < 3; {\n}", "for ;; {\n}", "for x < 3 {\n}",
    "for range ch {\n}", "for i := range 10 {\n\tcontinue\n}", "for k, v := range m {\n}", "for _, v = range []int{1} {\n}", "for _, p := range []T{{1}, {2}} {\n}", "switch {\ncase a > b, c:\n\tf()\n\tfallthrough\ndefault:\n}", "switch x := f(); x {\ncase 1:\n}", "switch v := x.(type) {\ncase int, *T, []byte, map[string]int, func(), chan int, nil:\n\t_ = v\n}",
    "switch x.(type) {\n}", "select {\ncase v := <-ch:\n\t_ = v\ncase ch <- 1:\ncase v, ok = <-ch:\ndefault:\n}", "ch <- <-other", "go func() { f() }()", "defer mu.Unlock()", "defer func() {\n\tif r := recover(); r != nil {\n\t}\n}()", "L:\n\tfor {\n\t\tgoto L\n\t}", "{\n\tx()\n}", "var a, b int = 1, 2", "const c = iota", "type local struct {\n\ta, b int `json:\"x\"`\n\t*T\n\tpkg.U\n\tG[int]\n\tarr [n]int\n}",
    "var f func(int, ...string) (a, b int)", "f = func(a, b int, c ...T) error { return nil }", "x, y = y, x", "x <<= 2; y &^= 3", "a[1:2], b[:], c[1:2:3], d[:2:3] = 1, 2, 3, 4", "_ = x.(T).y[0](1)(2)", "_ = []byte(\"x\")", "_ = [...]string{2: \"a\", \"b\"}", "_ = [2][3]int{{1}, {2}}", "_ = (<-chan int)(nil)", "_ = <-chan int(c)", "_ = *p.q", "_ = -x + ^y*!z", "_ = func() {}",
    "_ = Generic[int, map[string]T](x)", "_ = G[[]byte]{}", "_ = pkg.G[int]{x: 1}", "_ = interface{ M(int) string }(nil)", "_ = struct{ a int }{1}", "if f(T{1}) {\n}", "if x == (struct{}{}) {\n}", "for _, x := range f(T{}) {\n}", "_ = 'a' + '\\n' + 0x1F + 1e3 + 1i", "return", "_ = make([]chan<- int, 3)", "var ch <-chan (chan int)", "x++\ny--", "if x {\n} ; y()", ";", "f(\n\ta,\n\tb,\n)", "f(xs...)", "switch x := 1; {\n}",
    "if err := f(); err != nil { return }", "for i, j := 0, 1; i < j; i, j = i+1, j-1 {\n}", "var x interface {\n\t~int | ~string\n\tfmt.Stringer\n}", "switch f := x; f.y() {\ncase T{1}.a:\n}", "var _ = map[string]func(){\n\t\"a\": func() {},\n}", "_ = a.b.C{d: e{}}",
]
DECLARATIONS = [
    "type A = B", "type L[T any] []T", "type M[K comparable, V ~int | ~string] map[K]V", "type Arr [N * 2]int", "type Arr2 [N]int", "type F func(a, b int) (c string, err error)", "type (\n\tX int\n\tY = X\n)", "var (\n\ta int\n\tb = 1\n)", "const (\n\tc = iota\n\td\n\te float64 = 1\n)", "func G[T any, U interface{ ~[]T }](x T, us ...U) (T, error) { return x, nil }",
    "func (r *R[T]) M(int, string) {}", "func (R) N(a []int, b [4]T, c map[K]V, d G[int], e func()) chan int { return nil }", "func ext(a, b int) int", "type I interface {\n\tA\n\tpkg.B\n\tM(x int) (y int)\n\tN()\n}", "type S struct{}", "type E struct {\n\tG[int]\n\ta [2]int\n\tb []int\n\t*p.Q `tag`\n\tc, d chan<- int\n}", "func f(a, b, c int, d ...string) {}", "func f(func(int) string, []byte) {}", "func f() (func(), error) { return nil, nil }", "import_ := 1",
]
BAD_STATEMENTS = [
    "x :=", "x = = 1", "if {\n}", "if x = 1 {\n}", "if x := 1 {\n}", "for i := 0; i < 3 {\n}", "switch x {\ny()\n}", "f(1 2)", "f(,)", "a[", "a[]", "a[1:2:]", "x y", "return 1 2", "go f", "defer x.y", "1 +", "* ", "var x", "m := map[string]{}", "x := [3]", "else {\n}", "case 1:", "for x := range {\n}", "select {\ncase x y:\n}", "goto 1", "func named() {}", "x.", "x.(", "T{1, , 2}", "T{a: }",
    "x ? y : z", "while x {\n}", "if x {\n}\nelse {\n}", "import \"fmt\"", "a, b :=", "x +=", "for ; ; i++ x {\n}", "struct{ a }{1} 2", "&", "f(x...y)", "<-", "chan", "x := func", "type T", "type T struct { a, }", "const 1 = 2", "switch x.(type {\n}", "break 1", "continue x y", "{ x()", "try(x) {\n}",
]
BAD_DECLARATIONS = ["func f(a int, string) {}", "func f(a, b int, c) {}", "func () f() int {", "func f( {}", "func f() int int {}", "type", "type A B C", "var x int y", "x := 1", "func 1f() {}", "type S struct { a int b int }", "type I interface { M( }", "const c int", "func f[](x int) {}", "package q", "func f() { return } }", "var a = func() {", "type L[T any []T", "f()"]


@pytest.mark.parametrize("text", STATEMENTS)
def test_statements(text):
    got = functions(f"package p\n\nfunc f() {{\n{text}\n}}\n\nfunc g() {{}}\n")
    assert [f.name for f in got] == ["f", "g"]


@pytest.mark.parametrize("text", DECLARATIONS[:-1])
def test_declarations(text):
    assert [f.name for f in functions(f"package p\n\nimport (\n\t_ \"a\"\n\t. `b`\n)\nimport \"c\"\n\n{text}\n\nfunc last() {{}}\n")][-1:] == ["last"]


@pytest.mark.parametrize("text", BAD_STATEMENTS)
def test_statements_that_are_none(text):
    assert functions(f"package p\n\nfunc f() {{\n{text}\n}}\n\nfunc g() {{}}\n") == []


@pytest.mark.parametrize("text", [*BAD_DECLARATIONS, DECLARATIONS[-1]])
def test_declarations_that_are_none(text):
    assert functions(f"package p\n\n{text}\n\nfunc last() {{}}\n") == []


def test_deep_nesting_is_no_error():
    assert len(functions("package p\nfunc f() {\n_ = " + "(" * 20_000 + "1" + ")" * 20_000 + "\n}\n")) == 1
