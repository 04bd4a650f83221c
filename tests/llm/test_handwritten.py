import random

from tessera.llm.handwritten import body_key, classified_files, features, measured_files, split_notice

WORDS = "river stone copper window garden yellow basket engine forest silver market".split()


def hand(rnd, n=25):
    out = []
    for _ in range(n):
        a, b, c = (rnd.choice(WORDS) for _ in range(3))
        out.append(rnd.choice([f"def {a}_{b}({c}):\n    # keep the {a} near the {b}\n    return {c} + {rnd.randint(1, 99)}", f"{a} = {b}({c}, {rnd.randint(1, 999)})", f"if {a} > {b}:\n    {c} = {a}.{b}()"]))
    return "\n".join(out)


def mini(rnd, n=300):
    return ";".join(f"function {rnd.choice('abcdefg')}{k}(e,t){{return e?t:{rnd.randint(0, 99)}}}" for k in range(n))


def test_notices():
    for text in ("// Code generated by x. DO NOT EDIT.\npackage a\n", "/* @generated */\nx\n", "# AUTO-GENERATED FILE by x compiler, changes will be lost\nx = 1\n"):
        assert split_notice("/r/a.go", text)[0] == 1
    assert split_notice("/r/a.js", "// Copyright (c) The Cache Authors. BSD 3-clause.\nx\n")[0] == 2 and split_notice("/r/vendor/x/a.js", "x")[0] == 2
    assert split_notice("/r/a.min.js", "x")[0] == 1 and split_notice("/r/deps.lock-3.json", '{"lockfileVersion": 2}')[0] == 1
    for text in ("# generated values are cached below\nx = 1\n", "# do not edit the cache by hand\nx = 1\n", "# minified output is written elsewhere\n", "// Licensed to the workshop. See the notice in the root folder.\nx\n", "x = 1\n# generated by hand below\n"):
        assert split_notice("/r/vendor_portal/a.py", text)[0] == 0, text
    assert split_notice("/r/a.py", "# Generated by x\nx = 1\n")[1].strip() == "x = 1"
    assert len(features("a.py", "")) == len(features("a.py", "x = 1\n"))


def test_notices_in_other_languages_and_places():
    for text in ("// Dieser Code wurde automatisch von x erzeugt.\nx\n", "# Ce fichier est produit par x, ne pas le changer\nx = 1\n", "// Archivo generado automáticamente\nx\n", "/*\n * nicht von Hand bearbeiten\n */\nx\n"):
        assert split_notice("/r/a.ts", text)[0] == 1, text
    assert split_notice("/r/a.go", "package a\n\n// Code generated by x. DO NOT EDIT.\nvar b = 1\n")[0] == 1
    assert split_notice("/r/a.js", "/*!\n * thread toolkit 3.13.16\n */\nx\n")[0] == 1 and split_notice("/r/a.cpp", "/*!\n * Reads the table.\n */\nint x;\n")[0] == 0
    for name in ("AOuterClass.java", "a.gen.rs", "a_string.go", "a_autogen.h", "a.pb.go", "a_pb2.py", "yarn.lock"):
        assert split_notice("/r/" + name, "x")[0] == 1, name
    assert split_notice("/r/word_pb.java", "x")[0] == 0 and split_notice("/r/user_data.py", "x = 1\n")[0] == 3 and split_notice("/r/vendor/x/README.md", "x")[0] == 2
    # words of notices in code and in other sentences
    for text in ('x = "generated by the tool"\n', "# Die Datei liest alle Werte\nx = 1\n", "# le fichier relit la table\nx = 1\n"):
        assert split_notice("/r/a.py", text)[0] == 0, text


def test_body_key():
    assert body_key("int a = 1;\n  int b;\n") == body_key("// header\r\nint a = 1; int b;  // end\r\n") != body_key("int a = 2;\nint b;\n")
    assert body_key(" \n") is None and body_key("// only\n") is not None


def test_notices_behind_long_texts():
    licence = "".join(f"// line {k} of a long licence text\n" for k in range(200))
    assert split_notice("/r/a.go", licence + "// Code generated by x. DO NOT EDIT.\npackage a\n")[0] == 1
    assert split_notice("/r/a.js", licence + "// Copyright (c) The Cache Authors.\nx\n")[0] == 2
    notice, body = split_notice("/r/deps.json", '{"dependencies": {' + ", ".join(f'"package{k}": "1.0.{k}"' for k in range(500)) + '}, "lockfileVersion": 2}')
    assert notice == 1 and "lockfileVersion" not in body


def test_forest_finds_what_has_no_notice(spark):
    rnd = random.Random(4)
    files, chunks, truth = [], [], set()
    for k in range(240):
        kind = "mini" if k % 4 == 0 else "hand"
        text = mini(rnd) if kind == "mini" else hand(rnd)
        if kind == "mini":
            truth.add(k)
            if k % 12 != 4:
                text = "// generated by bundler\n" + text
        files.append((k, f"/r{k % 9}/src/f{k}.js" if kind == "mini" else f"/r{k % 9}/src/f{k}.py", f"/r{k % 9}"))
        lines = text.split("\n")
        for j in range(0, len(lines), 10):
            chunks.append((1000 * k + j, k, j + 1, "\n".join(lines[j : j + 10])))
    copy = "\n".join(f"copied line number {j} of a foreign project" for j in range(9))
    for k in (900, 901):
        files.append((k, f"/r{k}/lib/x.py", f"/r{k}"))
        chunks.append((10**6 + k, k, 1, copy))
        truth.add(k)
    for k, root in ((903, "/r903"), (904, None), (905, "/r903")):  # one copy of an unknown root, which lies below a known one; short bodies
        files.append((k, f"/r903/lib/y{k}.py", root))
        chunks.append((10**6 + k, k, 1, "y = 5"))
    f = spark.createDataFrame(files + files[:3] + [(950, "/r/none.py", None)], "id long, path string, project_root string").withColumnRenamed("probability", "p")
    c = spark.createDataFrame(chunks + chunks[:5] + [(10**7, None, 1, "x"), (10**7 + 1, 960, 1, None)], "id long, file_id long, start_line int, content string")
    got = {r["file_id"] for r in classified_files(f, c).filter("is_foreign").collect()}
    assert len(truth - got) <= 4 and {900, 901} <= got and len(got - truth) <= 4
    assert {r["file_id"]: r["roots"] for r in measured_files(f, c).filter("file_id >= 900").collect()} == {900: 2.0, 901: 2.0, 903: 1.0, 904: 1.0, 905: 1.0}
    assert classified_files(f.limit(0), c.limit(0)).count() == 0
    assert classified_files(f.filter("id % 4 = 1"), c).filter("is_foreign").count() == 0
