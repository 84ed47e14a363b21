from orrery.operators import code
from orrery.parse.extract import File
from orrery.shipping import ship

PY = '"""Auth helpers."""\nimport os\nfrom pkg.util import join, split\n\nclass A:\n    def m(self):\n        return 1\n\ndef f(x: int):\n    return {}\n'
RUST = "use crate::auth::{login, logout};\nuse std::fmt::*;\n\npub struct P { x: u8 }\n\nimpl P {\n    pub fn new() -> P { P { x: 1 } }\n}\n"


def test_python():
    f = File(PY, "Python")
    assert [(k, n, a, b) for _, k, n, _, a, b in f.chunks()] == [("Preamble", "", 1, 1), ("ImportBlock", "", 2, 3), ("TypeHeader", "A", 5, 7), ("Function", "f", 9, 10)]
    assert [(s[2], s[1], s[8], s[3], s[4], s[5]) for s in f.symbols()] == [("class", "A", "", 5, 7, "class A:"), ("function", "A.m", "A", 6, 7, "def m(self):"), ("function", "f", "", 9, 10, "def f(x: int):\n    return")]
    assert f.imports() == [("module", "os", [], 2), ("named", "pkg.util", ["join", "split"], 3)]


def test_rust():
    f = File(RUST, "Rust")
    assert [(k, n, a, b) for _, k, n, _, a, b in f.chunks()] == [("ImportBlock", "", 1, 2), ("TypeHeader", "P", 4, 4), ("TypeHeader", "P", 6, 8)]
    assert [(s[2], s[1], s[3], s[5], s[7], s[8]) for s in f.symbols()] == [("struct", "P", 4, "pub struct P", "pub", ""), ("impl_block", "P", 6, "impl P", "", ""), ("function", "P.new", 7, "pub fn new() -> P", "pub", "P")]
    assert f.imports() == [("named", "crate::auth", ["login", "logout"], 1), ("wildcard", "std::fmt::*", [], 2)]
    assert File("pub use crate::z;", "Rust").imports() == [("module", "pub use crate::z", [], 1)]
    assert File("extern crate q;", "Rust").imports() == [("module", "q", [], 1)]


def test_imports_of_the_others():
    ts = "import R, {a as b} from './r'\nimport './s.css'\nimport * as ns from 'x'\nexport { q } from './z';\n"
    assert File(ts, "TypeScript").imports() == [("named", "./r", ["R", "a"], 1), ("side_effect", "./s.css", [], 2), ("default", "x", [], 3), ("reexport", "./z", [], 4)]
    assert File("import static a.B.c;\nimport com.x.*;\n", "Java").imports() == [("named", "a.B.c", [], 1), ("wildcard", "com.x.*", [], 2)]
    assert File('#include "a/b.h"\n#include <s.h>\n', "C").imports() == [("include", "a/b.h", [], 1), ("include", "s.h", [], 2)]
    go = 'package a\n\nimport (\n\t"fmt"\n\tu "x/y/util"\n)\n'
    assert File(go, "Go").imports() == [("module", "fmt", [], 3), ("module", "x/y/util", [], 3)]
    py = "import a as b, c\nfrom .m import x\nfrom . import y\nfrom q import *\nfrom z import z\nfrom __future__ import annotations\n"
    assert File(py, "Python").imports() == [("module", "c", [], 1), ("named", "..m", ["x"], 2), ("named", "..", ["y"], 3), ("wildcard", "q", [], 4), ("module", "z", [], 5)]


def test_what_ends_the_header():
    """Whatever is neither import nor comment at the root ends the header, so no import block follows it."""
    assert not any(c[1] == "ImportBlock" for c in File('package a\n\nimport "fmt"\n\nfunc F() {}\n', "Go").chunks())
    assert not any(c[1] == "ImportBlock" for c in File("from __future__ import annotations\nimport os\n\ndef f():\n    pass\n", "Python").chunks())
    assert any(c[1] == "ImportBlock" for c in File("# note\nimport os\n\ndef f():\n    pass\n", "Python").chunks())


def test_preamble_swallows_what_stands_before_a_late_comment():
    got = File("x = 1\n# late\ndef f():\n    pass\n", "Python").chunks()
    assert got[0][:2] == ("x = 1\n# late", "Preamble")


def test_exports_have_no_symbols():
    f = File("export class K { m() {} }\nclass L {}\n", "TypeScript")
    assert [(c[1], c[2]) for c in f.chunks()] == [("Declaration", ""), ("TypeHeader", "L")]
    assert [s[0] for s in f.symbols()] == ["L"]


def test_c_functions_have_no_names():
    f = File("struct q { int a; };\nint f(int a) { return 1; }\n", "C")
    assert [(c[1], c[2]) for c in f.chunks()] == [("TypeHeader", "q"), ("Function", "")]
    assert [s[0] for s in f.symbols()] == ["q"]


def test_java_members():
    f = File("package a;\npublic class Z {\n  private int f;\n  public Z() {}\n  /** d */\n  protected int m(int a) { return 1; }\n}\n", "Java")
    assert [(s[0], s[2], s[6], s[7], s[8]) for s in f.symbols()] == [("Z", "class", "", "public", ""), ("m", "method", "/** d */", "protected", "Z")]


def test_decorated():
    f = File("@d(1)\ndef g(a):\n    return 1\n", "Python")
    assert [(c[1], c[2], c[4], c[5]) for c in f.chunks()] == [("Function", "g", 1, 3)]
    assert [(s[0], s[2], s[3], s[5]) for s in f.symbols()] == [("g", "function", 1, "@d(1)\ndef g(a):")]


def test_large_definitions_are_split():
    body = "".join(f"    def m{k}(self):\n        return '{'x' * 60}'\n\n" for k in range(8))
    got = File("class Big:\n    field = 1\n" + body, "Python", 300).chunks()
    assert got[0][1:4] == ("TypeHeader", "Big", "") and got[0][0] == "class Big:"
    assert [(c[1], c[2], c[3]) for c in got[1:]] == [("Method", f"m{k}", "class_definition Big") for k in range(8)]
    long = "@d\ndef f():\n" + "".join(f"    a{k} = {k}\n" for k in range(60))
    assert {c[1] for c in File(long, "Python", 200).chunks()} == {"TextWindow"}
    assert all(len(c[0].encode()) <= 200 for c in File(long, "Python", 200).chunks())


def test_files(spark):
    ship(spark)
    rows = [(1, "pkg/auth.py", PY), (2, "a.txt", "words\n"), (3, "b.py", None), (4, "c.py", "x = 1\n"), (5, None, "z"), (6, "bad.rs", "fn ( { ]] }")]
    f = spark.createDataFrame(rows, "id bigint, path string, text string")
    a = code.analyze(f)
    got = [(r.id, r.chunk_index, r.kind) for r in code.chunks(a).orderBy("id", "chunk_index").collect()]
    assert got[:4] == [(1, 0, "Preamble"), (1, 1, "ImportBlock"), (1, 2, "TypeHeader"), (1, 3, "Function")]
    assert (2, 0, "TextWindow") in got and (4, 0, "TextWindow") in got and not any(g[0] == 3 for g in got)
    assert code.symbols(a).count() == 3 and code.imports(a).count() == 2
    head = code.chunks(a).where("id = 1 and kind = 'TypeHeader'").first().context_header
    assert head == "// File: pkg/auth.py\n// Type: A"
