import os

from sylvan.engine import Engine
from sylvan.sources import files


def test_a_folder_of_any_file_system(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("def f(): pass\n")
    (tmp_path / "sub" / "b.hpp").write_text("class B {};\n")
    (tmp_path / "c.txt").write_text("no\n")
    (tmp_path / ".hidden.py").write_text("x = 1\n")
    found = sorted((os.path.basename(r["path"]), r["lang"], r["source"]) for r in files.scan(spark, f"file://{tmp_path}").collect())
    assert found == [("a.py", "python", "def f(): pass\n"), ("b.hpp", "cpp", "class B {};\n")]
    assert [r["lang"] for r in files.scan(spark, str(tmp_path), "c++").collect()] == ["cpp"]


def test_files_that_cant_be_read_give_no_rows(spark, tmp_path):
    (tmp_path / "a.go").write_text("package a\nfunc F() {}\n")
    table = files.read(spark, [(str(tmp_path / "a.go"), "go"), (str(tmp_path / "gone.go"), "go")])
    assert {r["path"][-7:]: r["source"] is None for r in table.collect()} == {str(tmp_path / "a.go")[-7:]: False, "gone.go": True}
    engine = Engine(spark, table)
    assert [r["name"] for r in engine.outline().collect()] == ["F"] and engine.languages == ("go",)


def test_empty_and_null_rows(spark):
    rows = [("a.c", "c", ""), ("b.c", "c", None), (None, "c", "int x;"), ("d.c", None, "int x;")]
    engine = Engine(spark, spark.createDataFrame(rows, "path string, lang string, source string"))
    assert engine.outline().count() == 0 and engine.search("id").count() == 0 and engine.edges().count() == 0
    nothing = Engine(spark, engine.given.limit(0))
    assert nothing.search("id#x").count() == 0 and nothing.languages == () and nothing.callees_text("x") == "x()\n" and nothing.definition("x").count() == 0
    assert nothing.search("id#x").columns == engine.search("id#x").columns


def test_long_nodes_are_cut_from_the_file(spark):
    long = "x" * 500
    source = f"int f(void) {{\n  g(\"{long}\");\n  h(\n1);\n}}\n"
    engine = Engine(spark, spark.createDataFrame([("a.c", "c", source)], "path string, lang string, source string"))
    assert [r["captures"][0]["start_line"] for r in engine.search(f'string_content#"{long}"').collect()] == [2]
    got = {r["rendered"] for r in engine.search("literal#/x{300}/").collect()}
    assert got == {f'<match>:2: "\\"{long}\\""'}
    whole = [r["rendered"] for r in engine.search("(*function @f)", body=True).collect()]
    assert whole == [f"@f:1-5: {source.rstrip()}"]
    assert {r["rendered"] for r in engine.search("(&function#h @c)").collect()} == {'@c:3: "h("'}
