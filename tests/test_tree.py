"""The tree source: what is opened, what is read, blocks of large files."""

import os
import time

import pytest
from prosewright.sources import tree


@pytest.fixture
def root(tmp_path):
    def put(name, text, age=0):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        os.utime(path, (time.time() - age, time.time() - age))

    put("a.md", "one\ntwo\n")
    put("x/b.md", "three")
    put("x/y/c.TXT", "Ünì\r\n\nlast")
    put("x/old.md", "old", age=9 * 86_400)
    put("node_modules/deep/er/d.md", "no")
    put("x/.git/objects/e.md", "no")
    put("x/y/empty.md", "")
    put("x/y/f.bin", b"\xff")
    return tmp_path


def relative(root, paths):
    return sorted(os.path.relpath(p, root) for p in paths)


def test_pruned_folders_are_never_opened(root, monkeypatch):
    seen = []
    real = tree.opened
    monkeypatch.setattr(tree, "opened", lambda store, folder, *a: seen.append(folder) or real(store, folder, *a))
    for enough in (1, 2, 100):  # all by a task, shared, all by the driver
        seen.clear()
        reader = tree.TreeReader({"path": str(root), "without": "node_modules,.git", "suffixes": "md,txt", "folders": str(enough)})
        found = [e[0] for p in reader.partitions() for e in reader.read(p)]
        assert relative(root, found) == ["a.md", "x/b.md", "x/old.md", "x/y/c.TXT", "x/y/empty.md"]
        assert set(relative(root, seen)) == {".", "x", "x/y"}


def test_entries(spark, root):
    since = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(time.time() - 86_400))
    got = tree.entries(spark, str(root), ["node_modules", ".git"], ["md"], since).collect()
    assert relative(root, [r.path for r in got]) == ["a.md", "x/b.md", "x/y/empty.md"]
    assert {(os.path.basename(r.path), r.size, r.start, r.end) for r in got} == {("a.md", 8, 0, 8), ("b.md", 5, 0, 5), ("empty.md", 0, 0, 0)}
    assert tree.entries(spark, str(root), [], ["none"]).count() == 0
    with pytest.raises(Exception, match="missing|not|No such"):
        tree.entries(spark, str(root / "nowhere")).count()


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_each_line_is_read_once_whatever_the_blocks(spark, tmp_path, block):
    text = "a\n\nbcd\r\n" + "é" * 5 + "\n\n\nend without a feed"
    (tmp_path / "t.log").write_bytes(text.encode() + b"\xff")
    got = tree.lines(tree.entries(spark, str(tmp_path), blockBytes=block), str(tmp_path), 3).orderBy("offset").collect()
    want, at = [], 0
    for row in (text.encode() + b"\xff").split(b"\n"):
        want.append((at, row.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(row) + 1
    assert [(r.offset, r.text) for r in got] == want


def test_documents_are_whole(spark, root):
    got = tree.documents(spark, str(root), ["node_modules", ".git"], ["md", "txt"]).collect()
    assert sorted((os.path.basename(r.path), r.format, r.raw) for r in got) == [("a.md", "md", "one\ntwo\n"), ("b.md", "md", "three"), ("c.TXT", "txt", "Ünì\r\n\nlast"), ("empty.md", "md", ""), ("old.md", "md", "old")]


def test_log_rows(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "new.jsonl").write_text('{"ts": "2099-01-02T00:00:00Z", "n": 1}\nbroken\n{"ts": "2000-01-01T00:00:00Z", "n": 2}\n{"n": 3}\n')
    (tmp_path / "k" / "old.jsonl").write_text('{"ts": "2099-01-02T00:00:00Z", "n": 4}\n')
    os.utime(tmp_path / "k" / "old.jsonl", (0, 0))
    assert [r.n for r in tree.log_rows(spark, str(tmp_path), "ts timestamp, n int", "ts", "2020-01-01T00:00:00").collect()] == [1]
