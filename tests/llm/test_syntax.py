"""Parsers accept what is valid and say where what isn't goes wrong."""

import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from suitelens.llm.syntax.files import parser, syntax_errors
from suitelens.llm.syntax.lalr import END, Recogniser, build

GOOD_JAVA = [
    "",
    "package a.b; import java.util.*; import static java.lang.Math.max;",
    "class A<T extends Comparable<T> & Runnable> extends B<Map<String, List<Integer>>> implements C { }",
    "class A { int[][] x = {{1, 2}, {3}, {}}; int y = a < b ? c >> 2 >>> 1 : d; }",
    "class A { void f() { for (int i = 0; i < n && j > m; i++) { g(i < 3, k > 4); } } }",
    "class A { Object o = (Runnable & java.io.Serializable) () -> { }; int c = (int) 'x' + (a) - 1; }",
    "record P<A, B>(A left, List<? super B> right) { P { check(left); } static int record = 1; }",
    "sealed interface S permits A, B { } non-sealed class A implements S { } final class B implements S { }",
    "enum E implements I { A(1) { int f() { return 2; } }, @X B, ; private int n; E(int... n) { } }",
    "class A { int f(int k) { return switch (k) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new X(); }; } }",
    "class A { void f() { switch (k) { case 1: case 2: a(); break; default: } } }",
    "@interface N { int value() default 1; String[] names() default {\"a\", \"b\"}; }",
    "class A { void f() throws X, Y { try (var r = open(); q) { r.read(); } catch (X | Y e) { } finally { } } }",
    "class A { String s = \"\"\"\n  a \" b\n  \"\"\"; char c = '\\''; char d = '\\u0041'; long l = 0x1FL; double e = 1e-3d; }",
    "class A { Supplier<List<String>> s = ArrayList<String>::new; F f = int[]::new; G g = this::<T>h; }",
    "class A { void f() { if (o instanceof String t && !t.isEmpty()) x = y = z; else label: while (true) break label; } }",
    "class A { A() { this(1); } A(int n) { super(n); } static { } { } default void f() { } synchronized void g() { synchronized (this) { } } }",
    "class A { Outer.Inner i = o.new Inner() { int f() { return Outer.this.x.y + A.super.f() + int.class.hashCode(); } }; }",
    "class A { int a = (x) -> x * 2, b = x -> (y, z) -> y; int[] c[] = new int[3][]; var d = (List<String>) e.f().<T>g()[0]; }",
    "/* a */ // b\n",
]
BAD_JAVA = [
    "class A {", "class A { } }", "class A { void f() { g() } }", "class A { void f() { 1 + 2; } }", "class A { int x = ; }",
    "class A { String s = \"open; }", "class A { /* open }", "<<<<<<< HEAD\nclass A { }", "class A { void f() { if x) { } } }",
    "```java\nclass A { }\n```", "class A { void f() { ... } }", "class A { char c = “x”; }", "{\"a\": 1}", "class A { def f(self): pass }",
    "class A { void f() { try { } } }", "class A { int f( { } }",
]


@pytest.mark.parametrize("code", GOOD_JAVA)
def test_valid_java(code):
    assert parser("java").first_error(code) is None


@pytest.mark.parametrize("code", BAD_JAVA)
def test_invalid_java(code):
    assert parser("java").first_error(code) is not None


def test_truncated_java_is_never_valid():
    code = GOOD_JAVA[9]
    for n in range(10, len(code) - 1):
        assert parser("java").first_error(code[:n]) is not None


def test_where_it_goes_wrong():
    assert parser("java").first_error("class A {\n  void f() {\n    g()\n  }\n}\n") == (4, "}")
    assert parser("json").first_error('{"a": 1,\n "b" 2}') == (2, "SCALAR")
    assert parser("java").first_error("class A {\n") == (2, "end of file")


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.integers(0, 60), st.sampled_from('{}[],:"\\ a1-.\n'))
def test_json_like_the_standard_library(value, at, c):
    code = json.dumps(value)
    assert parser("json").first_error(code) is None
    code = code[:at] + c + code[at + 1 :]
    try:
        json.loads(code, parse_constant=lambda _: 1 / 0)
        fine = True
    except Exception:
        fine = False
    assert (parser("json").first_error(code) is None) == fine


def test_python_like_the_standard_library():
    import random
    from pathlib import Path

    import suitelens

    texts = [p.read_text() for p in Path(suitelens.__file__).parent.rglob("*.py")]
    for text in texts:
        assert parser("python").first_error(text) is None
    r = random.Random(1)
    agree = total = 0
    for text in texts:
        lines = text.split("\n")
        for _ in range(6):
            i = r.randrange(len(lines))
            cut = "\n".join(lines[:i] + [lines[i][: r.randrange(len(lines[i]) + 1)]] + lines[i + 1 :])
            try:
                ast.parse(cut)
                fine = True
            except Exception:
                fine = False
            total += 1
            agree += (parser("python").first_error(cut) is None) == fine
    assert agree >= 0.97 * total


@pytest.mark.parametrize(
    "code,fine",
    [
        ("<a/>", True), ("<?xml version='1.0'?>\n<a b='1'>x &amp; &#65;<!-- c --><![CDATA[<]]></a>\n", True), ("", False),
        ("<a><b></a></b>", False), ("<a b='1' b='2'/>", False), ("<a>&nope;</a>", False), ("<a/><b/>", False),
        (" <?xml version='1.0'?><a/>", False), ("<a b=1/>", False), ("<a>", False), ("text", False), ("<a>]]></a>", False),
    ],
)
def test_xml(code, fine):
    assert (parser("xml").first_error(code) is None) == fine


@pytest.mark.parametrize(
    "code,fine",
    [
        ("", True), ("a: 1\nb:\n  - x\n  - y: z\n", True), ("a:\n- 1\n- 2\n", True), ("a: |\n  <<<<<<<\n  ====\nb: [1, {c: d}]\n", True),
        ("a: 'it''s'\nb: \"x\\n\"\n", True), ("---\na: &x 1\nb: *x\n...\n", True), ("a: [1, 2\n", False), ("a: \"x\nb: 1", False),
        ("a: 1\n\tb: 2\n", False), ("a: {b: [1}\n", False), ("a: 1\n<<<<<<< HEAD\nb: 2\n", False), ("a: b: c\n", False), ("- a\nb: c\n", False),
        ("a: 1\n  b: 2\n", False), ("? x\n: y\n", True), ("# only\n", True), ("a: >-\n  folded\n  text\n", True),
    ],
)
def test_yaml(code, fine):
    assert (parser("yaml").first_error(code) is None) == fine


def test_remembered_stretches_change_nothing():
    tables = parser("java").run.t
    plain = Recogniser(tables)
    number = tables.terminals
    for code in [*GOOD_JAVA, *BAD_JAVA] * 2:
        kinds, _ = parser("java").lexer(code, {})
        coded = bytes([number.get(k, len(number)) for k in kinds])
        assert plain.first_error(coded) == parser("java").run.first_error(coded)


def test_small_grammar():
    tables = build("S : 'a' S? 'b' | 'c'+")
    run = Recogniser(tables)
    code = lambda text: bytes(tables.terminals[c] for c in text)
    assert [run.first_error(code(x)) for x in ("ab", "aabb", "aacbb", "ccc", "abb", "a", "")] == [None, None, None, None, 2, 1, 0]
    assert END in tables.terminals and not tables.conflicts


def test_operator_cases(spark):
    rows = [(1, "a.java", "class A { }", 1), (2, "a.JAVA", "class A {", 2), (3, "b.json", "", 3), (4, "c.txt", "class {", 4), (5, None, "x", 5),
            (6, "d.py", None, 6), (7, "e.yml", "a: [", None), (8, "f.java", "class A { int x = 1; }\n" + "// x\n" * 20000, 8), (2, "a.JAVA", "class A {", 2)]
    df = spark.createDataFrame(rows, "file_id long, path string, code string, language long")
    out = syntax_errors(df.withColumnRenamed("language", "extra"), "file_id", "path", "code")
    assert sorted(r.file_id for r in out.collect()) == [2, 2, 3, 7]
    assert syntax_errors(df.limit(0), "file_id", "path", "code").count() == 0


@pytest.mark.parametrize("value,fine", [
    ("09", False), ("0x", False), ("0b1", True), ("017", True), ("0xFFL", True), ("1_000", True), ("1_", False), ("0x1.8p3", True), ("0x1.8", False), ("09.5", True), ("0", True), ("089f", True),
    ('"\\q"', False), ('"\\d+"', False), ('"a\\\\d"', True), ('"\\u00e9\\n\\101"', True), ("'\\x'", False), ("'\\''", True), ('"""\n a \\\n b"""', True),
])
def test_java_literals(value, fine):
    assert (parser("java").first_error(f"class A {{ Object x = {value}; }}") is None) == fine


@pytest.mark.parametrize("code", [
    "1 = x", "f() = 2", "del f()", "f(a=1, a)", "def f(*): pass", "def f(a, a=1, b): pass", "f(**k, *a)", "a := 1", "for 1 in x: pass", "with a as 1: pass",
    "f'{a'", "f'{}'", "b'\u00e9'", "x = '\\x1'", "class Tests Assigned: pass", "def f(a=1, b): pass", "None = 1", "a + 1 = 2", "[a, 1] = x", "lambda: (yield) = 1", "import a.b as c.d", "a, b += 1",
])
def test_python_that_is_not_allowed(spark, code):
    rows = [(1, "a.py", code), (2, "b.py", "x = 1\n"), (3, "c.py", None), (4, "d.py", "")]
    assert [r.id for r in syntax_errors(spark.createDataFrame(rows, "id long, path string, code string"), "id", "path", "code").collect()] == [1]
