import ast
import json

import pytest
from codelode.llm.derivatives import Grammar
from codelode.llm.grammars import check
from codelode.llm.syntax import checked, invalid_rates

GOOD = {
    ".py": ["", "x = 1", "def f(a, *, b=1, **k) -> int:\n    return a if b else [*k]\n", "match x:\n    case [1, *r] if r: pass\n    case _: pass\n", "async def f():\n    async with a as b, c:\n        await d\n", "@d\nclass C(A, m=1):\n    x: int = 3\n",
            "try:\n    pass\nexcept* E as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "a = b = lambda *a, k=1: (yield)\n", "print(f'{x!r}', *y, **z)\nd = {**a, 'b': 1}\ns = {i async for i in x}\nt = x[1:2, ::3]\n", "if (n := 3) > 2: pass\nelif n: pass\n", "type = 3\nmatch = type\n"],
    ".js": ["", "export default class extends A { static #x = 1; get y() { return this.#x } async *z() {} }", "const {a, b: [c = 1], ...d} = e ?? f?.g?.[h]?.();", "for (const [k, v] of Object.entries(x)) if (k) continue; else break", "label: for (;;) { break label }",
            "import x, {y as z} from 'm'\nexport {z}\nconst f = async (a) => { await a }\nlet r = /[/\"]/g.test(s) ? `a${`b${c}`}` : 1n", "a = b\n++c\nvar x = function* () { yield* y }", "!function(){'use strict';for(var i=0;i<n.length;i++)x[i]=n[i]^3;y&&(z=1,z.a('b'))}()", "switch (a) { case 1: b(); default: { } }", "if (a) b\nelse c"],
    ".ts": ["interface A<T extends B = C> extends D { readonly x?: number; [k: string]: T; m<U>(a: U): void }", "type X = { [K in keyof T]?: T[K] } & (A | B)[] ;", "export const f = <T,>(a: T, ...b: string[]): Map<string, Array<T>> => new Map<string, Array<T>>();", "abstract class A<T> implements B { constructor(private readonly x: number) { super() } abstract y(): void; z!: string }",
            "enum E { A = 1, B }\ndeclare module 'm' { const x: number }\nlet y = <any>z as unknown as number[];\nfunction f(this: A, x?: number): x is B;", "const a = b! satisfies C;\nlet g: typeof x extends (infer U)[] ? U : never"],
    ".go": ["package p\n", 'package p\n\nimport (\n\t"a"\n\tb "c/d"\n)\n\ntype T[K comparable] struct {\n\tA, B int `tag`\n\t*C\n}\n\nfunc (t *T[K]) M(a ...int) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn\n\t} else if x == 2 {\n\t}\n\tfor i := range a {\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T[K]:\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\ts := []map[string]int{{"a": 1}, {}}\n\t_ = s[1:2]\n\treturn 1, nil\n}\n'],
    ".java": ["package a.b;\nimport static x.Y.*;\n@A(x = {1, 2})\npublic sealed class C<T extends D & E> extends F<T> implements G permits H {\n  private final Map<String, List<? super T>> m = new HashMap<>();\n  static { int[] a = {1, 2}; }\n  C(int... x) throws IOException { this(); }\n  <U> U f(U u) { return (U) (Object) u; }\n  int g(int x) { return switch (x) { case 1, 2 -> 3; default -> { yield 4; } }; }\n  void h() { try (var r = a()) { l.forEach(C::new); } catch (A | B e) { } for (var x : y) ; Runnable q = () -> {}; if (o instanceof String s && !s.isEmpty()) { } int[][] z = new int[3][]; }\n  enum E2 { A(1) { }, B; }\n  record R(int a, String b) { R { } }\n  @interface I { int v() default 1; }\n}\n"],
    ".json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "[]", "3"],
    ".yaml": ["", "a: 1\nb:\n- x\n- y: 2\n  z: 3\nc: {d: [1, 2], e: 'f'}\ng: |\n  free: [text\nh: >-\n  more\ni: plain text\n  goes on\n", "---\n- a\n- - b\n  - c\n...\n", "k: \"a\\\"b\" # c\n? q\n", "a: &x 1\nb: *x\n"],
    ".sh": ["", "#!/bin/sh\nset -eu\nf() {\n  if [ \"$a\" -gt 1 ] && b; then\n    echo \"x $(ls | wc -l) ${y:-z}\"\n  elif c; then :; else d; fi\n  for i in 1 2; do echo $i; done > out 2>&1\n  case $x in a|b) ;; *) e ;; esac\n  while read l; do :; done <<EOF\nif then $(\nEOF\n}\nA=1 f arg # c\n(cd x; y) | z &\n"],
}
BAD = {
    ".py": ["def f(:\n", "x = 'a\n", "if a\n    pass\n", "print 'x'\n", "x = [1, 2\n", "def f():\n", "<<<<<<< HEAD\nx = 1\n", "  x = 1\n y = 2\n", "a b\n", "return = 1\n", "try:\n    pass\n"],
    ".js": ["function f( {", "const x = ;", "let a b", "if (a { }", "x = 'a\n'", "} catch { {", "package x;\nimport (\n\"a\"\n)", '{"a": 1, "b": 2}', "please check the old index", "const x;", "a = (1", "class A { x( }"],
    ".ts": ["interface A { x: number", "const a: = 1", "type X = ", "func f() {}", "let a: Map<string, number = 1;", "=======\nlet a = 1"],
    ".go": ["package p\n\nfunc f( {\n}\n", "package p\nfunc f() {\n", "package p\nx := 1\n", "package p\n<<<<<<< a\n", "def f():\n    pass\n", 'package p\nvar s = "a\n'],
    ".java": ["class A { void f() { int x = ; } }", "class A {", "class A { void f( { } }", "int x = 1;", "package a\nclass B { }", 'class A { String s = "a; }'],
    ".json": ["", "{a: 1}", "[1,]", '{"a": NaN}', "[1] x", "// c\n{}", '{"a": 01}', '"a\nb"', "{'a': 1}"],
    ".yaml": ["a: b: c\n", "a: [1, 2\n", "a: 'x\n", "\ta: 1\n", "a: 1\n  b: 2\n", "- a\nb: 1\n", "a: \"x\" y\n", "<<<<<<< HEAD\na: 1\n=======\n"],
    ".sh": ["if a; then b\n", "f() {\n", "echo \"a\n", "done\n", "for i in a; do b; fi\n", "a ||\n", "(a\n", "case x in a) b\n", "x=$(ls\n", "<<<<<<< HEAD\nls\n"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_valid(ext):
    for text in GOOD[ext]:
        assert check(text, ext) is None, text
        assert check(text.replace("\n", "\r\n"), ext) is None, text


@pytest.mark.parametrize("ext", BAD)
def test_invalid(ext):
    for text in BAD[ext]:
        assert check(text, ext) is not None, text


def test_own_sources_and_their_truncations():
    from pathlib import Path

    import codelode.llm.grammars as g

    text = Path(g.__file__).read_text()
    assert check(text, ".py") is None
    for cut in range(0, len(text), 997):
        part = text[:cut]
        try:
            ast.parse(part)
            good = True
        except SyntaxError:
            good = False
        assert (check(part, ".py") is None) == good, part[-80:]


def test_json_agrees_with_a_parser():
    import random

    rng = random.Random(1)
    base = json.dumps({"a": [1, 2.5, {"b": None}], "c": "d\\e", "f": True})

    def strict(t):
        def no(_):
            raise ValueError

        try:
            json.loads(t, parse_constant=no)
            return True
        except ValueError:
            return False

    for _ in range(500):
        k = rng.randrange(len(base))
        t = base[:k] + rng.choice('{}[],:"1a ') + base[k + rng.randrange(2) :]
        assert (check(t, ".json") is None) == strict(t), t


def test_truncation_is_told_from_a_wrong_token():
    g = Grammar("s: '(' s ')' | X", "s", {}, {})
    assert g.fault(["(", "X", ")"]) == -1 and g.fault(["(", "X"]) == 2 and g.fault(["(", ")"]) == 1


def test_operator(spark):
    t = "timestamp'2024-01-01 00:00:00'"
    rows = [(1, "p", "a.py", 0, "def f():"), (2, "p", "a.py", 1, "    return 1"), (2, "p", "a.py", 1, "    return 1"), (3, "p", "b.py", 0, "def f("), (4, "p", "c.json", 0, None), (5, "p", "d.md", 0, "((("), (6, None, None, None, "x"), (7, "p", "e.JSON", 0, "{"), (8, "p", "f.py", 0, "x = 1\n" * 20_000)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, project_id string, rel_path string, chunk_index int, content string").selectExpr("*", f"{t} as ingested_at", "'z' as text", "1 as rows", "2 as lang_name")
    kinds = spark.createDataFrame([(".py", "python", True), (".py", "python", True), (".json", "json", True), (".md", "markdown", False), (".zz", "z", True)], "extension string, lang_name string, has_grammar boolean")
    out = {r["rel_path"]: (r["fault"], r["line_no"]) for r in checked(chunks, kinds).collect()}
    assert out == {"a.py": (None, None), "b.py": ("truncated", 1), "e.JSON": ("truncated", 1), "f.py": (None, None)}
    rates = {r["lang_name"]: (r["files"], r["invalid"]) for r in invalid_rates(chunks, kinds).collect()}
    assert rates == {"python": (3, 1), "json": (1, 1)}
    assert checked(chunks.limit(0), kinds).count() == 0


def test_a_suffix_without_a_grammar_here_is_reported(spark):
    import pytest
    from codelode.llm.syntax import checked

    chunks = spark.createDataFrame([("p", "a.zz", 0, 1, None, "x")], "project_id string, rel_path string, chunk_index int, chunk_id bigint, ingested_at timestamp, content string")
    kinds = spark.createDataFrame([(".zz", "Zed", True)], "extension string, lang_name string, has_grammar boolean")
    with pytest.warns(UserWarning, match=r"\.zz"):
        assert checked(chunks, kinds).count() == 0
