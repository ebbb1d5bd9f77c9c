"""Listing trees of files, and the events that listings give."""

import os
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corpuslens.engine import Engine
from corpuslens.sources import files, walk
from corpuslens.streaming import folder, watch

TREE = (
    "a.txt", "B.TXT", "none", "sub/c.md", "sub/deep/er/d.pdf", ".hidden/e.txt", ".claude/f.txt", "sub/.git/g.txt", "node_modules/x/h.txt", "sub/node_modules/i.txt", "build/j.txt",
    "_under/k.txt", "dist.txt", "sub/l.DS_Store", ".DS_Store", "big.txt", "空 白/m n.txt", "sub/%41#?.txt",
)


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "w"
    for name in TREE:
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * (2000 if name == "big.txt" else 3))
    os.symlink(root / "sub", root / "link")
    os.symlink(root / "a.txt", root / "link.txt")
    return root


def plain_walk(root, rules):
    """The walk of one process: (path, bytes)."""
    out = set()
    for at, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if rules.enters(f"{at}/{d}", d) and not os.path.islink(f"{at}/{d}")]
        out |= {(f"{at}/{n}", os.path.getsize(f"{at}/{n}")) for n in names if rules.lists(f"{at}/{n}", n, os.path.getsize(f"{at}/{n}"))}
    return out


@pytest.mark.parametrize("first", [1, 3, 1000])
def test_the_walk_is_that_of_one_process(spark, tree, first):
    for rules in (walk.Rules(), walk.Rules(files.DEFAULT_EXCLUDES), walk.Rules(files.DEFAULT_EXCLUDES, [".TXT", "md"], 1000), walk.Rules(("**/sub", "*.txt"))):
        got = walk.walk(spark, str(tree), rules, first, first)
        assert {(r.path, r.size_bytes) for r in got.collect()} == plain_walk(str(tree), rules)
    known = {r.path: r for r in walk.walk(spark, str(tree), walk.Rules(files.DEFAULT_EXCLUDES)).collect()}
    names = {p[len(str(tree)) + 1 :] for p in known}
    assert names == {"a.txt", "B.TXT", "none", "sub/c.md", "sub/deep/er/d.pdf", ".claude/f.txt", "_under/k.txt", "dist.txt", "sub/l.DS_Store", "big.txt", "空 白/m n.txt", "sub/%41#?.txt", "link.txt"}
    asked = spark.createDataFrame([(f"{tree}/{n}",) for n in (*TREE, "not/there.txt", "sub")] + [("/etc/hosts",)], "path string")
    assert {r.path: r for r in walk.looked_up(asked, str(tree), walk.Rules(files.DEFAULT_EXCLUDES)).collect()} == {p: r for p, r in known.items() if "link" not in p}


def test_excluded_folders_are_not_entered(tree, monkeypatch):
    entered, real = [], walk.entries
    for k in range(300):
        (tree / "node_modules" / f"p{k}").mkdir()
    monkeypatch.setattr(walk, "entries", lambda at: entered.append(at) or real(at))
    list(walk.visit([str(tree)], walk.Rules(files.DEFAULT_EXCLUDES), 10**9))
    assert len(entered) == len(set(entered)) == 7 and not any("node_modules" in x or ".git" in x or "build" in x for x in entered)
    assert not list(walk.visit([f"{tree}/gone"], walk.Rules(), 10))


def test_documents_of_a_root_that_only_spark_lists(spark, tree, monkeypatch):
    own = files.discover(spark, f"file://{tree}", "w").select("path", "kind", "size_bytes", "mtime")
    monkeypatch.setattr(walk, "rooted", lambda *_: None)
    scanned = files.discover(spark, f"file://{tree}", "w").select("path", "kind", "size_bytes", "mtime")
    wanted = {tuple(r) for r in scanned.filter(~F.col("path").rlike("/link/")).collect()}
    extra = {tuple(r) for r in own.collect()} - wanted
    assert wanted <= {tuple(r) for r in own.collect()} and {x[0].rsplit("/", 2)[1] for x in extra} <= {".claude", "_under"}  # names that Spark passes over


class Handle:
    """State of one key, in memory."""

    def __init__(self):
        self.map, self.value = {}, None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        handle = self

        class Value:
            exists = lambda _: handle.value is not None

            def update(self, x):
                handle.value = x

        return Value()

    iterator = lambda self: iter([((k,), v) for k, v in self.map.items()])
    removeKey = lambda self, k: self.map.pop(k[0])

    def updateValue(self, k, v):
        self.map[k[0]] = v


def test_events_of_listings():
    import pandas as pd

    own = folder.Differences()
    own.init(Handle())

    def step(tick, **listed):
        rows = [(tick, None, None, None)] + [(tick, p, *v) for p, v in listed.items()]
        out = list(own.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["tick", "path", "size_bytes", "changed"])]), None))
        return {(r.path, r.event_type) for f in out for r in f.itertuples()}

    assert step(1, a=(1, 1), b=(1, 1)) == set()  # what is there when the watch begins
    assert step(2, a=(1, 1), b=(1, 1), c=(5, 2)) == set()  # may still be written
    assert step(3, a=(1, 1), c=(6, 3)) == {("b", "deleted")}
    assert step(4, a=(1, 4), c=(6, 3)) == {("c", "created")}
    assert step(5, a=(1, 4), c=(6, 3), d=(1, 1)) == {("a", "modified")}
    assert step(6, a=(1, 4), c=(6, 3)) == set()  # came and went
    assert step(7) == {("a", "deleted"), ("c", "deleted")} and step(8) == set()


def test_a_step_that_fails_is_worked_off_in_halves(spark):
    events = spark.createDataFrame([(f"/p{k}", "created") for k in range(20)], "path string, event_type string")
    done, failed, counts = set(), {}, []

    def work(part):
        paths = {r.path for r in part.collect()}
        if paths & {"/p3", "/p11"}:
            raise ValueError("bad")
        done.update(paths)

    watch.in_halves(events, work, counts.append, lambda p, e: failed.update({p: str(e)}))
    assert failed == {"/p3": "bad", "/p11": "bad"} and done == {f"/p{k}" for k in range(20)} - failed.keys() and sum(counts) == 18


def test_a_watch_follows_a_folder_by_itself(spark, tmp_path):
    root = tmp_path / "w"
    (root / "sub").mkdir(parents=True)
    (root / "old.txt").write_text("there from the start")
    (root / "gone.txt").write_text("leaves soon")
    engine = Engine(spark, f"file://{tmp_path}/store")
    ws = engine.add_workspace(str(root))
    engine.index(ws)
    monitored = folder.BUCKETS, folder.TASKS
    folder.BUCKETS, folder.TASKS = 4, 2
    query = engine.start_watch(ws, step="1 second")
    try:

        def until(test, limit=150):
            end = time.time() + limit
            while time.time() < end and query.isActive:
                if test():
                    return True
                time.sleep(1)
            return test()

        names = lambda: {r.name for r in engine.documents().collect()}
        assert until(lambda: query.lastProgress is not None)
        (root / "sub" / "new.md").write_text("# fresh words")
        (root / "gone.txt").unlink()
        assert until(lambda: names() == {"old.txt", "new.md"}), names()
        (root / "sub" / "new.md").rename(root / "moved.md")
        (root / "old.txt").write_text("rewritten entirely")
        os.utime(root / "old.txt", (datetime.now(timezone.utc).timestamp() + 5,) * 2)
        assert until(lambda: names() == {"old.txt", "moved.md"} and engine.chunks().filter(F.col("text").contains("rewritten")).count() == 1), names()
        assert until(lambda: engine.watches.list()[0]["events_processed"] >= 4, 30)
    finally:
        folder.BUCKETS, folder.TASKS = monitored
        engine.watches.stop_all()


def test_references_of_html_without_a_semicolon():
    from corpuslens.sources.extractors import html_to_text

    page = "<title>a&amp;&amp</title><p>R&D &ltb &ampx; &copy; &#233; &#x27; &amp;lt; & &</p>"
    assert html_to_text(page) == "a&&\nR&D <b &x; © é ' &lt; & &"
    assert html_to_text(page, closed=True) == "a&&amp\nR&D &ltb &ampx; © é ' &lt; & &"


def test_query_of_html_texts_is_its_sql_for_cut_titles(spark, tmp_path):
    from oracle import check

    from corpuslens.plans.catalog import ORACLES, QUERIES

    pages = [(1, "http://a/1", "<title>a&amp;&amp</title><p>b &lt;c&gt; &amp;lt;</p>"), (2, "http://a/2", None), (3, "http://a/3", "<p>x&amp</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    check(QUERIES["html_text"], ORACLES["html_text"], spark, str(tmp_path))
