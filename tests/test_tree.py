import os

from resemblage.sources import tree


def put(root, path, text="package p\nfunc f() {}\n"):
    place = root / path
    place.parent.mkdir(parents=True, exist_ok=True)
    place.write_text(text)


def test_walk(tmp_path):
    for p in ("_x.go", ".x.go", "x_test.go", "a.go", "a/b.go", "a-b.go", "vendor/v.go", "a/testdata/t.go", ".hid/h.go", "build/b.go", "c.GO", "n.txt", "dir.go/in.go"):
        put(tmp_path, p)
    got = [os.path.relpath(p, tmp_path) for p in tree.walk(str(tmp_path))]
    assert got == [".hid/h.go", ".x.go", "_x.go", "a/b.go", "a-b.go", "a.go", "dir.go/in.go", "x_test.go"] or got == sorted(got, key=lambda p: p.split("/"))


def test_roots(tmp_path):
    put(tmp_path, "vendor/v.go")
    assert list(tree.walk(str(tmp_path / "vendor"))) == [] and list(tree.walk(str(tmp_path / "none"))) == []
    assert list(tree.walk(str(tmp_path / "vendor/v.go"))) == [str(tmp_path / "vendor/v.go")]


def test_files_and_units(spark, tmp_path):
    put(tmp_path, "b.go", "package b\nfunc g() { f() }\nfunc h() {}\n")
    put(tmp_path, "a.go")
    put(tmp_path, "bad.go", "package p\nfunc (\n")
    os.symlink(tmp_path / "gone", tmp_path / "c.go")
    found = tree.files(spark, str(tmp_path))
    rows = {os.path.basename(r["path"]): r for r in found.collect()}
    assert rows["c.go"]["content"] is None and "c.go" in rows["c.go"]["warning"] and rows["a.go"]["warning"] is None
    units = tree.parse(found).orderBy("ord").collect()
    assert [(u["name"], u["package"], u["callees"]) for u in units] == [("f", "p", []), ("g", "b", ["f"]), ("h", "b", [])]


def test_numbered(spark):
    df = spark.createDataFrame([(p, b"") for p in ("a-b.go", "a.go", "a/b.go")], "path string, content binary")
    assert [r["path"] for r in tree.numbered(df).orderBy("file_ord").collect()] == ["a/b.go", "a-b.go", "a.go"]


def test_a_tree_on_any_file_system(spark, tmp_path):
    for p in ("x_test.go", "a.go", "a/b.go", "a-b.go", "vendor/v.go", "a/testdata/t.go", "build/b.go", "c.GO", "n.txt", "dir/in.go"):
        put(tmp_path, p, f"package p\nfunc f{len(p)}() {{}}\n")
    local = [(os.path.relpath(r["path"], tmp_path), bytes(r["content"])) for r in tree.files(spark, str(tmp_path)).orderBy("file_ord").collect()]
    remote = [(r["path"].removeprefix(f"file://{tmp_path}/"), bytes(r["content"])) for r in tree.files(spark, f"file://{tmp_path}/").orderBy("file_ord").collect()]
    assert remote == local and len(local) == 5
    assert tree.files(spark, f"file://{tmp_path}/vendor").count() == 0


def test_files_of_a_small_table_are_dealt_to_many_tasks(spark):
    from resemblage.plans.queries import go_files

    assert go_files(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 10
