"""Tables in buckets against whole-table changes, by the files written; a folder followed exactly once."""

import pytest
from callweave.operators import mutations, store
from callweave.streaming import files
from pyspark.sql import functions as F

CHUNK = "chunk_id string, document_id string, ordinal int, text string"


def _chunks(spark):
    return spark.createDataFrame([(f"c{d}.{k}", f"d{d}", k, f"t{d}.{k}") for d in range(40) for k in range(5)] + [("none", None, 1, "no document")], CHUNK)


def _versions(path):
    return {p.name: p.parent.name for p in (path / "data").glob("v*/_bucket=*")}


def test_deleting_a_document_rewrites_its_bucket(spark, tmp_path):
    path = tmp_path / "s"
    store.create(_chunks(spark), str(path), "document_id", 4)
    before = _versions(path)
    assert set(before.values()) == {"v00000001"} and sorted(map(tuple, store.read(spark, str(path)).collect()), key=str) == sorted(map(tuple, _chunks(spark).collect()), key=str)
    gone = spark.createDataFrame([("d7",)], "document_id string")
    own, n = store.delete(spark, str(path), gone, ["document_id"])
    assert n == 5 and len(own) == 1
    new = [p for p in (path / "data/v00000002").rglob("*.parquet")]
    assert len({p.parent.name for p in new}) == 1
    want, _ = mutations.delete_document(_chunks(spark), "d7")
    assert sorted(map(tuple, store.read(spark, str(path)).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r["text"] for r in store.read(spark, str(path), own).collect()} < {r["text"] for r in want.collect()}


def test_upsert_update_and_keys(spark, tmp_path):
    path = str(tmp_path / "s")
    store.create(_chunks(spark), path, "document_id", 8)
    new = spark.createDataFrame([("c3.1", "d3", 9, "new"), ("c3.1", "d3", 8, "old"), ("c99.0", "d99", 0, "added")], CHUNK)
    own = store.upsert(spark, path, new)
    want = mutations.upsert(_chunks(spark), new)
    assert len(own) <= 2 and sorted(map(tuple, store.read(spark, path).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    keys = spark.createDataFrame([("c3.1", "d3"), ("c5.0", "d5"), ("absent", "d5")], "chunk_id string, document_id string")
    _, n = store.delete(spark, path, keys, ["chunk_id", "document_id"])
    left, counted = mutations.delete_keys(want, keys)
    assert n == counted.first()[0] == 2
    assert sorted(map(tuple, store.read(spark, path).collect()), key=str) == sorted(map(tuple, left.collect()), key=str)
    t = spark.createDataFrame([(k, f"s{k}", None) for k in range(30)], "id int, status string, updated_at string")
    store.create(t, str(tmp_path / "t"), "id", 8)
    changes = spark.createDataFrame([(3, None, ["status"]), (4, "x", [])], "id int, status string, set array<string>")
    store.update(spark, str(tmp_path / "t"), changes, ["status"], F.lit("now"))
    want = mutations.update(t, changes, ["status"], F.lit("now"))
    assert sorted(map(tuple, store.read(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_all_rows_may_go_and_come(spark, tmp_path):
    path = str(tmp_path / "s")
    store.create(_chunks(spark).where("document_id = 'd1'"), path, "document_id", 4)
    store.delete(spark, path, spark.createDataFrame([("d1",)], "document_id string"), ["document_id"])
    assert store.read(spark, path).count() == 0
    store.upsert(spark, path, _chunks(spark).where("document_id = 'd2'"))
    assert store.read(spark, path).count() == 5
    assert store.change(spark, path, _chunks(spark).limit(0), lambda rows: rows) == set()


def test_a_lost_writer_and_a_stray_row_change_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.create(_chunks(spark), path, "document_id", 8)
    one = spark.createDataFrame([("d1",)], "document_id string")
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.delete(spark, path, one, ["document_id"])
    assert store.read(spark, path).count() == 201
    with pytest.raises(Exception, match="does not touch"):
        store.change(spark, path, one, lambda rows: _chunks(spark))
    assert store.read(spark, path).count() == 201
    assert store.delete(spark, path, one, ["document_id"])[1] == 5 and store.read(spark, path).count() == 196
    assert len({p.parent.name + p.name for p in (tmp_path / "s/data").glob("v*/_bucket=*")}) <= 9


def test_a_batch_tried_again_counts_once(spark, tmp_path, monkeypatch):
    folder, table = tmp_path / "in", str(tmp_path / "t")
    folder.mkdir()
    made = []

    def make(paths, now):
        made.append(paths.count())
        new = paths.select(F.element_at(F.split("path", "/"), -1).alias("name"))
        return new if now is None else now.unionByName(new)  # appends: a batch that ran twice would show

    def run():
        return files.follow_into(spark, str(folder), str(tmp_path / "cp"), table, make).awaitTermination(120)

    (folder / "a.txt").write_text("x")
    plain = files.replace_table

    def written_then_lost(*args):
        plain(*args)
        raise RuntimeError("lost between the write and the stream's own note")

    with monkeypatch.context() as m:
        m.setattr(files, "replace_table", written_then_lost)
        with pytest.raises(Exception, match="lost between"):
            run()
    assert files.applied(spark, table) == {"files": 0}
    assert run()
    (folder / "b.txt").write_text("x")
    (folder / "c.txt").write_text("x")
    assert run()
    assert sorted(r["name"] for r in files.current_table(spark, table).collect()) == ["a.txt", "b.txt", "c.txt"]
    assert made == [1, 2] and files.applied(spark, table) == {"files": 1}
