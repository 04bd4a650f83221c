import pytest

from tessera.functions.symbols import extract_calls, extract_symbols

PY = "class Ledger:\n    def post(self, amount):\n        return record(amount)\n\ndef record(value):\n    return value\n"
CASES = {
    "python": (PY, [("Ledger", "class", 1, 3), ("post", "function", 2, 3), ("record", "function", 5, 6)]),
    "cpp": ("class Box {\npublic:\n    int size() { return 1; }\n};\n\nint area(int a) {\n    return a;\n}\n", [("Box", "class", 1, 4), ("size", "function", 3, 3), ("area", "function", 6, 8)]),
    "go": ("package a\n\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Size() int {\n\treturn b.n\n}\n\nfunc area(a int) int {\n\treturn a\n}\n", [("Box", "class", 3, 5), ("Size", "function", 7, 9), ("area", "function", 11, 13)]),
    "rust": ("struct Box {\n    n: u32,\n}\n\nimpl Box {\n    fn size(&self) -> u32 {\n        self.n\n    }\n}\n", [("Box", "class", 1, 3), ("", "function", 5, 9), ("size", "function", 6, 8)]),
    "javascript": ("class Box {\n  size() {\n    return 1;\n  }\n}\n\nfunction area(a) {\n  return a;\n}\n", [("Box", "class", 1, 5), ("size", "function", 2, 4), ("area", "function", 7, 9)]),
    "typescript": ("class Box {\n  size(a: number): number {\n    return 1;\n  }\n}\nexport async function area(a: any): Promise<any> {\n  return a;\n}\n", [("Box", "class", 1, 5), ("size", "function", 2, 4), ("area", "function", 6, 8)]),
    "java": ("public class Box {\n    public int size(int a) {\n        return a;\n    }\n}\n", [("Box", "class", 1, 5), ("size", "function", 2, 4)]),
    "c_sharp": ("class Box {\n    public int Size(int a) {\n        return a;\n    }\n}\n", [("Box", "class", 1, 5), ("Size", "function", 2, 4)]),
    "php": ("<?php\nclass Box {\n    function size($a) {\n        return 1;\n    }\n}\n", [("Box", "class", 2, 6), ("size", "function", 3, 5)]),
    "ruby": ("class Box\n  def size\n    1\n  end\nend\n", [("Box", "class", 1, 5), ("size", "function", 2, 4)]),
}


@pytest.mark.parametrize("language", CASES)
def test_symbols(language):
    text, want = CASES[language]
    got = [(s.symbol_name, s.symbol_type, s.start_line, s.end_line) for s in extract_symbols(text, language)]
    assert got == want


def test_unknown_empty_and_broken():
    assert extract_symbols("anything", "cobol") == [] == extract_symbols("", "python") == extract_symbols(None, "go") == extract_symbols("class A {", "java")
    assert [s.symbol_name for s in extract_symbols("def a():\n    return (\n\ndef b():\n    pass\n", "python")] == ["a", "b"]


def test_calls():
    assert [n for _, n in extract_calls(PY, "python")] == ["record"]
    assert [n for _, n in extract_calls("function f(a) {\n  if (a) { g(a); o.h(a); g(1); }\n  return 'x(1)'; // y(2)\n}\n", "javascript")] == ["g", "g"]
    assert [n for _, n in extract_calls("int f(int a) {\n    return g(a) + std::h(a) + p->q();\n}\n", "cpp")] == ["g"]
