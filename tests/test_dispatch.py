"""Calls that go to many targets: which ones, and how many rows are written for them."""

from pathlib import Path

import pyarrow.dataset as ds

from sylvan.engine import Engine
from sylvan.runtime import shared_dir

MANY = 40
GROUPS = """package g
type A interface {
	Do()
	X()
}
type B interface {
	Do()
	Y()
}
func (t T1) Do() {}
func (t T1) X() {}
func (t T1) Y() {}
func (t T2) Do() {}
func (t T2) X() {}
func (t T3) Do() {}
func (t T3) Y() {}
func (t T4) Do() {}
func (t T4) X() {}
func (t T4) Y() {}
func U(a A, b B, t T3) {
	t.Do()
	a.Do()
	b.Do()
}
func V(a A, b B, t T3) {
	b.Do()
	a.Do()
	t.Do()
	a.Do()
}
"""


def test_groups_of_targets(spark):
    wide = "package w\ntype W interface {\n\tRun()\n}\n" + "".join(f"func (s S{i}) Run() {{}}\nfunc Use{i}(w W, s S{i}) {{\n\tw.Run()\n\ts.Run()\n}}\n" for i in range(MANY))
    at = Path(shared_dir(spark).removeprefix("file://"), "sylvan", spark.sparkContext.applicationId)
    old = set(at.glob("*"))
    engine = Engine(spark, spark.createDataFrame([("g/g.go", "go", GROUPS), ("w/w.go", "go", wide)], "path string, lang string, source string"))
    rows = engine.graph.named(owner="receiver").collect()
    found = sorted((r["src_name"], r["owner"], r["line"], r["is_guess"]) for r in rows if r["src_path"] == "g/g.go")
    assert found == [
        ("U", "T1", 22, True), ("U", "T2", 22, True), ("U", "T3", 21, False), ("U", "T4", 22, True),
        ("V", "T1", 26, True), ("V", "T2", 27, True), ("V", "T3", 26, True), ("V", "T4", 26, True),
    ]
    pairs = [(r["src_name"], r["dst_name"], r["owner"]) for r in rows if r["src_path"] == "w/w.go"]
    assert len(pairs) == len(set(pairs)) == MANY * MANY  # the direct call is the later one
    # no table that was written holds the pairs
    assert {p.name: n for p in set(at.glob("*")) - old if (n := ds.dataset(str(p)).count_rows()) >= MANY * MANY} == {}
