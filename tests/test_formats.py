import os

import pytest
from pyspark.sql import functions as F

from siftstone.sources import formats


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {"a/one.md": "one", "a/b/two.md": "zwei é", "three.md": "", "a/four.txt": "4", ".hidden/x.md": "no", "a/.y.md": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bad.md").write_bytes(b"a\xffb")
    return root


def read(df):
    return sorted((r["name"], r["path"], r["text"]) for r in df.collect())


def test_a_tree_is_read(spark, tree):
    whole = [("bad", "bad.md", "a\ufffdb"), ("one", "a/one.md", "one"), ("three", "three.md", ""), ("two", "a/b/two.md", "zwei é")]
    assert read(formats.read_notes(spark, str(tree), "*.md")) == whole
    assert read(formats.read_notes(spark, f"file://{tree}", "*.md")) == whole
    assert len(read(formats.read_notes(spark, str(tree)))) == 5
    assert read(formats.read_notes(spark, str(tree / "a" / "one.md"))) == [("one", "one.md", "one")]
    (tree / "empty").mkdir()
    assert read(formats.read_notes(spark, str(tree / "empty"))) == []
    with pytest.raises(Exception, match="FileNotFound"):
        formats.read_notes(spark, str(tree / "none")).collect()


def test_conditions_on_the_path_are_taken_by_the_reader(spark, tree):
    os.chmod(tree / "three.md", 0o644)
    notes = formats.read_notes(spark, str(tree), "*.md")
    for condition, names in ((F.col("path") == "a/one.md", ["one"]), (F.col("path").startswith("a/"), ["one", "two"]), (F.col("path").endswith("o.md"), ["two"]), (F.col("path").isin("three.md", "bad.md"), ["bad", "three"]), ((F.col("path").startswith("a/")) & (F.col("text") == "one"), ["one"])):
        assert sorted(r["name"] for r in notes.where(condition).collect()) == names
    reader = formats.NotesReader({"path": str(tree), "pattern": "*.md", "files": "1"})
    left = list(reader.pushFilters([formats.StringStartsWith(("path",), "a/"), formats.EqualTo(("text",), "one")]))
    assert [f.attribute for f in left] == [("text",)]
    assert [p.paths for p in reader.partitions()] == [["a/b/two.md"], ["a/one.md"]]


def test_partitions_are_bounded(tree):
    files = [formats.Listed(f"f{i}", size, 0) for i, size in enumerate([5, 5, 100, 1, 1, 1, 1])]
    assert [p.paths for p in formats.dealt("r", files, 10, 3)] == [["f0", "f1"], ["f2"], ["f3", "f4", "f5"], ["f6"]]


def test_notes_that_arrive_are_read_once(spark, tree, tmp_path):
    formats.register(spark)
    stream = spark.readStream.format("siftstone_notes").option("pattern", "*.md").load(str(tree))
    got = []

    def once():
        out = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: got.extend(r["path"] for r in df.collect()))
        out.trigger(availableNow=True).start().awaitTermination()

    once()
    assert sorted(got) == ["a/b/two.md", "a/one.md", "bad.md", "three.md"]
    (tree / "later.md").write_text("later")
    once()
    assert sorted(got) == ["a/b/two.md", "a/one.md", "bad.md", "later.md", "three.md"]


def test_a_tree_is_written_whole_or_not(spark, tmp_path):
    root = tmp_path / "out"
    rows = [(f"d{i % 7}/f{i}.md", f"text {i}") for i in range(100)] + [("top.md", None)]
    formats.write_tree(spark.createDataFrame(rows, "path string, text string").repartition(5), str(root))
    assert {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()} == {p: t or "" for p, t in rows}
    before = sorted(map(str, root.rglob("*")))
    for bad in ("../x", "/x", "c:\\x", "", None, "a/../../x", formats.STAGED + "/x"):
        with pytest.raises(Exception, match="unsafe path"):
            formats.write_tree(spark.createDataFrame([("new.md", "n"), (bad, "B")], "path string, text string").repartition(2), str(root))
        assert sorted(map(str, root.rglob("*"))) == before
    with pytest.raises(Exception, match="one path|the path"):
        formats.write_tree(spark.createDataFrame([("new.md", "1"), ("new.md", "2")], "path string, text string").repartition(2), str(root))
    assert sorted(map(str, root.rglob("*"))) == before
    formats.write_tree(spark.createDataFrame([("top.md", "again")], "path string, text string"), str(root))
    assert (root / "top.md").read_text() == "again"
    formats.write_tree(spark.createDataFrame([], "path string, text string"), str(root))


def test_a_failing_task_leaves_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "out"
    rows = spark.range(0, 40, 1, 4).select(F.format_string("f%d.md", F.col("id")).alias("path"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    with pytest.raises(Exception, match="broken"):
        formats.write_tree(rows, str(root))
    assert not root.exists() or list(root.rglob("*")) == []
    # a task that goes on after the write was given up
    from types import SimpleNamespace

    writer = formats.TreeWriter(str(root))
    monkeypatch.setattr(formats, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(taskAttemptId=lambda: 1)))

    def rows_then_end():
        yield {"path": "a.md", "text": "a"}
        writer.abort([])
        yield {"path": "b.md", "text": "b"}

    with pytest.raises(RuntimeError, match="given up"):
        writer.write(rows_then_end())
    assert not root.exists()
