"""The store: changes touch few parts, are seen whole or not at all, and what a failed one wrote isn't read."""

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import embed
from corpuslens.plans import store as st

KINDS = "id string, document_id string, workspace_id string, text string"


def chunks(spark, rows):
    return spark.createDataFrame([(f"c{d}", d, "w", t) for d, t in rows], KINDS)


def test_a_change_touches_the_parts_of_its_documents_only(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/s", parts=8)
    store.write("chunks", chunks(spark, [(f"d{k}", "old") for k in range(40)]))
    before = store._state()[1]["now"]["chunks"]
    ids = spark.createDataFrame([("d7",)], "document_id string")
    store.change(ids, {"chunks": lambda old: st.replace_children(old, store.typed("chunks", chunks(spark, [("d7", "new")])), ids)})
    after = store._state()[1]["now"]["chunks"]
    assert before.keys() == after.keys() and sum(before[p] != after[p] for p in before) == 1
    assert {r.document_id: r.text for r in store.read("chunks").collect()} == {f"d{k}": "new" if k == 7 else "old" for k in range(40)}
    store.change(ids.filter("false"), {"chunks": lambda old: old.filter("false")})
    assert store.read("chunks").count() == 40
    store.delete_documents(ids)
    assert store.read("chunks").count() == 39 and store.read("chunks").filter("document_id = 'd7'").isEmpty()
    assert st.Store(spark, f"file://{tmp_path}/s", parts=3).read("chunks").count() == 39  # a store keeps its number of parts


def test_a_failed_change_leaves_all_tables_as_they_were(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/s", parts=4)
    store.commit({"chunks": chunks(spark, [("a", "x")]), "entities": spark.createDataFrame([("a", "x")], "document_id string, text string")})
    ids = spark.createDataFrame([("a",)], "document_id string")
    with pytest.raises(Exception):
        store.change(ids, {"chunks": lambda old: old.filter("false"), "entities": lambda old: old.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))})
    assert store.read("chunks").first().text == "x" and store.read("entities").first().text == "x"
    number, state = store._state()
    with pytest.raises(RuntimeError, match="another writer"):
        store._log(number, state)


def test_a_text_that_cannot_be_embedded_is_told(spark):
    def picky(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[1.0, 0.0]] * len(texts)

    rows = spark.createDataFrame([("c1", "w", "d", "good"), ("c2", "w", "d", "bad"), ("c3", "w", "d", None), ("c4", "w", "d", " ")], "chunk_id string, workspace_id string, document_id string, text string")
    made = {r.chunk_id: r for r in embed.embed(rows, picky).collect()}
    assert made.keys() == {"c1", "c2"} and made["c1"].embedding == [1.0, 0.0] and made["c1"].error is None
    assert made["c2"].embedding is None and made["c2"].error == "ValueError: no"


def test_a_writer_that_read_an_older_state_gets_an_error(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/s", parts=2)
    row = lambda k: spark.createDataFrame([(k, f"/data/{k}")], "id string, root_path string")
    store.update("workspaces", lambda old: st.upsert(old, store.typed("workspaces", row("one")), "id"))

    def slow(old):
        store.update("workspaces", lambda now: st.upsert(now, store.typed("workspaces", row("three")), "id"))  # another writer comes between
        return st.upsert(old, store.typed("workspaces", row("two")), "id")

    with pytest.raises(RuntimeError, match="another writer"):
        store.update("workspaces", slow)
    assert {r.id for r in store.read("workspaces").collect()} == {"one", "three"}
    store.commit({"chunks": chunks(spark, [("a", "x"), ("b", "y")])})
    ids = spark.createDataFrame([("a",)], "document_id string")

    def between(old):
        store.delete_documents(spark.createDataFrame([("b",)], "document_id string"))
        return old.filter("false")

    with pytest.raises(RuntimeError, match="another writer"):
        store.change(ids, {"chunks": between})
    assert [r.document_id for r in store.read("chunks").collect()] == ["a"]
    number, state = store._state()
    used = {f.split("/")[1] for t in (state["now"], state["before"]) for f in t["chunks"].values()}
    left = {p.name for p in (tmp_path / "s" / "chunks").iterdir() if list(p.glob("part=*"))}
    assert left == used and len(list((tmp_path / "s" / "chunks").glob("0*"))) == 2  # what the loser wrote is gone
    assert not list((tmp_path / "s" / "_log").glob("*.draft"))


def test_many_writers_at_once_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = st.Store(spark, f"file://{tmp_path}/s", parts=2)
    store.update("workspaces", lambda old: old)

    def add(k):
        while True:
            try:
                return store.update("workspaces", lambda old: st.upsert(old, store.typed("workspaces", spark.createDataFrame([(f"w{k}",)], "id string")), "id"))
            except RuntimeError:
                continue
            except Exception as e:  # noqa: BLE001
                if "FILE_NOT_EXIST" not in str(e) and "does not exist" not in str(e) and "PATH_NOT_FOUND" not in str(e):  # two states on, its files may be gone
                    raise

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(8)))
    assert {r.id for r in store.read("workspaces").collect()} == {f"w{k}" for k in range(8)}


def test_a_workspace_goes_with_its_documents_in_one_step(spark, tmp_path):
    store = st.Store(spark, f"file://{tmp_path}/s", parts=2)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    store.commit({"workspaces": rows("w", "v"), "documents": spark.createDataFrame([("d", "w"), ("e", "v")], "id string, workspace_id string"), "chunks": chunks(spark, [("d", "x")])})
    number = store._state()[0]
    store.delete_workspace("w")
    assert store._state()[0] == number + 1 and [r.id for r in store.read("workspaces").collect()] == ["v"]
    assert [r.id for r in store.read("documents").collect()] == ["e"] and store.read("chunks").isEmpty()
    store.delete_workspace("v")
    assert store.read("workspaces").isEmpty() and store.read("documents").isEmpty()
