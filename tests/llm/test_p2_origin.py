from datetime import datetime

from orrery.llm import p2_origin
from orrery.shipping import ship

SCHEMA = "chunk_id bigint, file_id bigint, project string, rel_path string, lang string, chunk_index int, text string, kind string, line_start int, line_end int, context_header string, indexed_at timestamp, hash string, generated string, path string, n int"
HAND = "".join(f"def step_{c}(a):\n    total = a + len('{c}')\n    return work(total)\n\n" for c in "abcdefgh")
LIB = "// Helpers of a library.\nclass Deep {{\n{} }}\n".format("\n".join(f"  run{c}(x) {{ return x.map((y) => y + {i}); }}" for i, c in enumerate("abcdefg")))


def reasons(spark, files):
    ship(spark)
    rows = [(i, i, p, path, None, 0, t, None, 1, 1 + (t or "").count("\n"), None, datetime(2024, 1, 1), "x", "y", "z", 1) for i, (p, path, t) in enumerate(files)]
    return {r.file_id: list(r.reasons) for r in p2_origin.origin(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_signs(spark):
    numbers = ",\n".join(", ".join(str(i * j) for j in range(10)) for i in range(20))
    getters = "".join(f"def part_{i}(raw):\n    return raw[{i}]\n\n" for i in range(6))
    mini = "var a=1;" + "".join(f"function f{i}(b){{return b?b+{i}:f{i}(b)}};" for i in range(30))
    files = [
        ("p", "a.py", HAND),
        ("p", "b.py", "# Code generated by toolkit v3. DO NOT EDIT.\n\n" + HAND),
        ("p", "c.ts", "//\n//   This file was created by smith; changes will be lost.\n//\n\nexport const x = 1;\n"),
        ("p", "d.py", HAND + "# Automatisch erzeugt, nicht von Hand bearbeiten\n"),
        ("p", "e.py", "banner = '# DO NOT EDIT'\n" + HAND),
        ("p", "f.py", "# written by hand, unlike the generated stubs next door\n" + HAND),
        ("p", "g.py", "# do not edit this order without asking: later steps rely on it\n" + HAND),
        ("p", "h.py", getters),
        ("p", "i.js", mini),
        ("p", "j.py", "words = '" + "amber kelp " * 80 + "'\n" + HAND),
        ("p", "k.py", "TABLE = [\n" + numbers + "\n]\n"),
        ("p", "l.py", "SMALL = [1, 2, 3, 4]\n" + HAND),
        ("p", "m.json", "[" + numbers + "]"),
        ("p", "n.py", None),
        ("p", "o.ts", "export default {\n" + ",\n".join(f'  "a{i}": {{"lat": {i}.5, "lon": 2.25}}' for i in range(40)) + "\n};\n"),
    ]
    got = reasons(spark, files)
    by = {files[i][1]: r for i, r in got.items()}
    assert by == {"a.py": [], "b.py": ["generated"], "c.ts": ["generated"], "d.py": ["generated"], "e.py": [], "f.py": [], "g.py": [], "h.py": ["generated"], "i.js": ["minified"], "j.py": [], "k.py": ["data"], "l.py": [], "o.ts": ["data"]}


def test_vendored(spark):
    files = [
        ("a", "third_party/kit/x.js", LIB),
        ("b", "src/y.js", LIB.replace("\n", "\r\n")),  # a copy with other line ends and no sign of its own
        ("c", "src/own.js", LIB.replace("run", "walk")),
        ("d", "vendor_portal/z.js", LIB.replace("run", "crawl")),
        ("e", "src/q.js", "/*!\n * kit v1.2.3 | (c) the kit authors | Permissive licence 2\n */\n" + LIB.replace("run", "jump")),
        ("f", "src/r.js", "// moved here from vendor/ and rewritten; nothing of the old licence applies\n" + LIB.replace("run", "sit")),
    ]
    got = reasons(spark, files)
    assert {files[i][0]: r for i, r in got.items()} == {"a": ["copied", "third party"], "b": ["copied", "third party"], "c": [], "d": [], "e": ["third party"], "f": []}


def test_shared_trees(spark):
    one, two = LIB.replace("run", "one"), LIB.replace("run", "two")
    files = [("a", "deep/er/m.js", one), ("a", "deep/er/n.js", two), ("b", "other/names/q.js", two), ("b", "other/names/r.js", one), ("c", "alone/m.js", one), ("d", "own.js", LIB.replace("run", "d")), (None, None, LIB.replace("run", "e"))]
    got = reasons(spark, files)
    assert {k: bool(v) for k, v in got.items() if k < 6} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False}


def test_files_shared_by_two_or_three_projects(spark):
    two, three = LIB.replace("run", "hop"), LIB.replace("run", "row")
    files = [("bramble", "src/a.js", three), ("larkspur", "lib/b.js", three), ("oak", "c.js", three), ("fallowmere", "src/d.js", two), ("turnstile", "e.js", two), ("oak", "f/g.js", LIB.replace("run", "dig")), ("oak", "h/i.js", LIB.replace("run", "dig")), ("a", "j.py", "x = 1\n"), ("b", "k.py", "x = 1\n")]
    got = reasons(spark, files)
    assert {k: bool(v) for k, v in got.items()} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}


def test_deep_trees_and_late_marks(spark):
    one, two = "x = 1\n", "y = 2\n"  # too small to be a copy by themselves
    deep = "src/main/java/com/firm/app/core/kit/lib"
    licence = "".join(f"# This line of the licence has the number {i}, and the rights it grants are many.\n" for i in range(80))
    files = [
        ("a", deep + "/m.py", one), ("a", deep + "/n.py", two), ("a", "src/main/java/com/firm/app/own.py", HAND),
        ("b", "p/q/r/s/t/u/v/w/x/y/z/k/l/o/1.py", one), ("b", "p/q/r/s/t/u/v/w/x/y/z/k/l/o/2.py", two), ("b", "p/q/r/s/t/u/own.py", HAND.replace("total", "whole")),
        ("c", "late.py", licence + "# Code generated by toolkit v3. DO NOT EDIT.\n\n" + HAND.replace("work", "toil")),
    ]
    got = reasons(spark, files)
    assert {k: r for k, r in got.items()} == {0: ["copied"], 1: ["copied"], 2: [], 3: ["copied"], 4: ["copied"], 5: [], 6: ["generated"]}


def test_whole_and_partly_copied_trees(spark):
    body = lambda w: LIB.replace("run", w)
    small = [(p, f"{k}.py", f"x{k} = {k}\n") for p in "ab" for k in range(3)]  # a whole repository of files too small to be copies by themselves
    partly = [("c", f"lib/kit/{k}.js", body(f"kit{k}")) for k in range(4)] + [("c", "lib/kit/own/patched.js", body("patched")), ("c", "src/own.js", body("mine"))]
    partly += [("d", f"x/{k}.js", body(f"kit{k}")) for k in range(4)] + [("d", "y.js", body("other"))]
    files = small + partly
    got = reasons(spark, files)
    assert {k: r for k, r in got.items() if r != ["copied"]} == {11: [], 16: []}


def test_empty(spark):
    assert reasons(spark, [("p", "a.txt", "x")]) == {}
