import ast
import warnings

import pytest

from tessera.llm.grammars import parses
from tessera.llm.syntax import judged_files, parse_rates

GOOD = {
    "python": ["", "x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    return [x for x in b if x]\n", "if a:\n    pass\nelif b: pass\nelse:\n    x: int = 3\n", "class A(B):\n    '''doc\n    <<<<<<< x'''\n    @p\n    async def f(self):\n        await g()\n", "print 'two'\n", "try:\n    a\nexcept (B, C) as e:\n    raise X from e\nfinally:\n    del a\n", "match x:\n    case [1, *r]:\n        pass\n    case A(b=2) | None:\n        pass\n", "T = f(lambda a, b=2: a if b else {**c, 'd': 1})\nx = y[1:2, ::3]\n", "with (open(a) as b, c):\n  pass\n", "x = (\n  1 +\n# note\n  2)\n"],
    "json": ['{"a": [1, 2.5e3, true, null, "\\u00e9"]}', "3", "[]"],
    "javascript": ["", "const f = async (a, {b, ...c}) => { await g(b) }\n", "a = b\nc()\nif (x) y()\nelse { z++ }\n", "class A extends B { static #x = 1; get y() { return this.#x } async *z() { yield* q } }", "for (const [k, v] of Object.entries(o)) { if (/[/]x/g.test(k)) continue; }", "!function(e,t){for(var i=0;i<3;i++)e[i]=t?1:{a:2}}(a,b)", "label: while (1) break label\nexport default function () {}\n", "import a, { b as c } from './x';\nconst s = `a ${b} <<<<<<<`;\n", "x = a?.b?.[c] ?? d ** 2\n"],
    "typescript": ["interface A<T> extends B { readonly a?: T[]; f(x: number): string }\n", "type X = { [k in keyof T]?: T[k] } | 'a' | null;\n", "export abstract class A<T extends object = {}> { constructor(private readonly a: string) { super() } abstract f(): void; }\n", "const x = y as unknown as Record<string, Array<number>>;\n", "enum E { A = 1, B }\nfunction f(this: A, x?: number): x is string { return x! > 1 }\n", "declare module 'x' { export function f(): void; }\n"],
    "go": ['package a\n\nimport (\n\t"fmt"\n\tx "b/c"\n)\n\ntype A struct {\n\tn, m int `json:"n"`\n\tB\n}\n\nfunc (a *A) F(x ...int) (int, error) {\n\tfor i, v := range x {\n\t\tif v > 1 {\n\t\t\tcontinue\n\t\t}\n\t\tswitch i {\n\t\tcase 1, 2:\n\t\t\tgo f(v)\n\t\tdefault:\n\t\t}\n\t}\n\treturn m[1], func() error { return nil }()\n}\n', "package a\n\nvar x = map[string][]int{\"a\": {1, 2}}\n\ntype G[T any] interface{ F(T) }\n"],
    "java": ["package a.b;\nimport java.util.*;\n@X(1) public final class A<T extends B & C> extends D implements E {\n private static final int[] x = {1, 2};\n A() { super(); }\n <R> Map<String, List<R>> f(final int a, String... b) throws E { for (var c : b) { x[0] += a > 1 ? 2 : (int) 3L; } return new HashMap<>() {{ put(\"a\", A::new); }}; }\n}", "record P(int a) {}\nenum Q { A, B { void f() {} }; int x; }\nsealed interface S permits T {}\n", "class A { void f(Object o) { switch (o) { case Integer i when i > 1 -> g(); default -> {} } Runnable r = () -> {}; try (var x = y()) { } catch (A | B e) { } } }"],
    "cpp": ["#include <x>\nnamespace a::b { template <typename T, int N = 3> class A : public B<T> { public: explicit A(int x) : x_(x), y{1} {} virtual ~A() = default; A& operator=(const A&) = delete; private: int x_; std::map<std::string, std::vector<int>> m; }; }\n", "int main(int argc, char** argv) { for (const auto& [k, v] : m) { auto f = [&, x = 1](int a) -> int { return a << x; }; if (auto p = q(); p) std::cout << \"a\" << f(1); } int a[3] = {1, 2}; return static_cast<int>(a[0]) ? 0 : 1; }\n", "struct S { unsigned x : 3; enum class E { A, B = 2 } e; };\nusing T = S;\ntypedef int (*fn)(int, char);\n"],
    "rust": ["use a::{b, c::*};\n#[derive(Debug)]\npub struct A<'a, T: Clone + 'a> where T: Copy { pub x: &'a T, y: Vec<u32> }\nimpl<'a, T> A<'a, T> { pub fn f(&mut self, n: u32) -> Result<u32, String> { let v = vec![1, 2]; match n { 0 | 1 => Ok(1), x if x > 3 => { g::<u32>(x)?; Ok(2) } _ => Err(format!(\"a {}\", n)), } } }\n", "fn f() -> u8 { let c = 'x'; loop { if let Some(x) = g() { break; } else if a < b { continue; } } for i in 0..=3 { s.iter().map(|x| x + 1).collect::<Vec<_>>(); } A { x: 1, ..b }.x }\n", "trait T { const X: u32 = 1; type Y; fn z(self) where Self: Sized; }\nenum E { A(u32), B { x: u8 }, C = 3 }\nmacro_rules! m { ($x:expr) => { $x } }\n"],
}
BAD = {
    "python": ["def f(:\n", "x = (1\n", "if a:\nb\n", "x = 'open\n", "  x\n y\n", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n", "a b c\n", "#include <x>\nint main() {}\n", "x = 1 +\n", "def f():\n\n"],
    "json": ["", "{", "{'a': 1}", '{"a": 1,}', "[1 2]", "01", '{"a": [}]', "nul"],
    "javascript": ["f(", "const = 3;", "a = 'x", "if (a { }", "<<<<<<< a\nb\n=======\n", "class { constructor( {} }", "x = ) y", "package a\n\nimport (\n)\n", "let x = 1 y = 2", "interface A { a: string }"],
    "typescript": ["let x: = 3;", "f(a: number", "const x: A<B> = * / {};", "type = ;"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nx = 1\n", "func f() {}\n", "package a\nfunc f() {\n\tx := := 1\n}\n", "import os\n\ndef f():\n    pass\n", ""],
    "java": ["class A {", "class A { int = 3; }", 'class A { String s = "x; }', "class A { void f() { = } }", "package a\n\nfunc f() {}\n"],
    "cpp": ["int f( {", "class A { int x };", "int f() { return }; }", "def f():\n    pass\n", "int f() { x = ; }", "package main\n\nfunc f() {}\n"],
    "rust": ["fn f( {}", "let x = 1;", "fn f() { let = 3; }", "struct A { x: }", "public class A { }", "fn f() { a ) }"],
}


MORE_GOOD = {
    "javascript": ["x = `a ${b ? `y ${c}` : ''} z`;\n", "x = `${{a: `}`}.a} ${f('`')} $ ${'}'}`\ny()\n", "if (x) /a(b/.test(y);\nwhile (f(x)) /[/]c/.exec(z)\n", "a = b / c / d;\nswitch (x) { case /y/.test(z): break }\n", "s = '\\x41\\u00e9\\u{1F600}\\d\\\n';\n"],
    "cpp": ["#if A\nint f(int x) {\n#else\nint f() {\n#endif\n  return 1;\n}\n", "#ifdef A\nclass B : public C {\n#elif D\nclass B : public E {\n#else\nclass B {\n#endif\n};\n", "#if A\n#include <a>\n#endif\nint x;\n"],
    "go": ['package a\n\nvar s = "\\n\\x41\\u00e9\\U0001F600\\101\\\\\\""\nvar r = \'\\\'\'\n'],
    "java": ['class A { String s = "\\n\\u0041\\0\\s"; char c = \'\\\'\'; String t = """\n a \\\n b "c"\n"""; }\n'],
    "rust": ["const S: &str = \"\\n\\u{1F600}\\x41\\0\\\n  b\";\nconst C: char = '\\'';\n"],
}
MORE_BAD = {
    "javascript": ["x = `a ${b ? `y` : '' z`;\n", "s = '\\xg1';\n", "s = '\\u12';\n", "x = `a ${b`;\n"],
    "cpp": ["#if A\nint f(int x) {\n#else\nint f( {\n#endif\n  return 1;\n}\n", "#if A\nint f() {\n#else\nint g() {\n"],
    "go": ['package a\n\nvar s = "\\R"\n', 'package a\n\nvar s = "\\d"\n', "package a\n\nvar s = '\\\"'\n"],
    "java": ['class A { String s = "\\R"; }\n', 'class A { String s = "\\u12"; }\n'],
    "rust": ['const S: &str = "\\R";\n', 'const S: &str = "\\u12";\n'],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in MORE_GOOD.items() for t in v])
def test_more_good(language, text):
    assert parses(text, language)


@pytest.mark.parametrize("language,text", [(k, t) for k, v in MORE_BAD.items() for t in v])
def test_more_bad(language, text):
    assert not parses(text, language)


def test_kinds_of_groups_are_bounded(monkeypatch):
    from tessera.llm import gll, grammars

    monkeypatch.setattr(gll, "MOST_KINDS", 1)
    for _ in range(3):
        assert parses("f((a)[b], {c: [d]})\n", "javascript") and not parses("f((a)[b], {c: [d)})\n", "javascript")
    assert len(grammars.JS._of) < 20


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_good(language, text):
    assert parses(text, language)


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BAD.items() for t in v])
def test_bad(language, text):
    assert not parses(text, language)


def test_own_sources_and_cuts_of_them_against_the_parser_of_python():
    import glob
    import random

    random.seed(1)
    for p in sorted(glob.glob("tessera/**/*.py", recursive=True)):
        text = open(p).read()
        assert parses(text, "python"), p
        for _ in range(3):
            cut = text[: random.randrange(len(text))]
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    ast.parse(cut)
                want = True
            except SyntaxError:
                want = False
            assert parses(cut, "python") == want, (p, cut[-200:])


def test_files(spark):
    files = spark.createDataFrame([(1, "/r/a.py", "/r", 0), (1, "/r/a.py", "/r", 0), (2, "/r/b.json", "/r", 0), (3, "/r/c.md", "/r", 0), (4, "/r/d.go", None, 0), (5, "/r/none.py", "/r", 0)], "id long, path string, project_root string, text int")
    chunks = spark.createDataFrame([(10, 1, 1, "def f():"), (11, 1, 2, "    pass"), (11, 1, 2, "    pass"), (12, 2, 1, "{"), (13, 3, 1, "(((("), (14, 4, 1, None), (15, None, 1, "x"), (16, 99, 1, "x")], "id long, file_id long, start_line int, content string")
    got = {r["file_id"]: r["valid"] for r in judged_files(files, chunks).collect()}
    assert got == {1: True, 2: False, 4: False}
    rates = {(r["project_root"], r["language"]): r["rate"] for r in parse_rates(judged_files(files, chunks)).collect()}
    assert rates == {("/r", "python"): 0.0, ("/r", "json"): 1.0, (None, "go"): 1.0}
    assert judged_files(files, chunks.limit(0)).count() == 0


def test_long_inputs_stay_linear():
    import time

    for language, unit, head, tail in (("cpp", "1, ", "int x[] = {", "1};"), ("javascript", '"a", ', "x = [", "1];"), ("python", "1, ", "x = [", "]\n"), ("rust", "1, ", "static X: &[u32] = &[", "1];"), ("java", "1, ", "class A { int[] x = {", "1}; }")):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            assert parses(head + unit * n + tail, language)
            took.append(time.process_time() - began)
        # four times the input: a square would take sixteen times as long, whatever the machine
        assert took[1] < 9 * took[0], (language, took)
