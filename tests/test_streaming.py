import os

from sylvan.operators.outline import outline
from sylvan.streaming import watch


def test_files_are_indexed_as_they_arrive(spark, tmp_path):
    folder, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()

    def go():
        query = watch.index(watch.arrivals(spark, str(folder)), table, state, available_now=True)
        query.awaitTermination(120)
        return sorted((os.path.basename(r["path"]), r["name"]) for r in outline(watch.current(spark, table)).collect())

    (folder / "a.py").write_text("def one(): pass\n")
    (folder / "b.txt").write_text("def no(): pass\n")
    assert go() == [("a.py", "one")]
    (folder / "c.go").write_text("package c\nfunc Two() {}\n")
    (folder / "a2.py").write_text("def three(): pass\n")
    assert go() == [("a.py", "one"), ("a2.py", "three"), ("c.go", "Two")]
