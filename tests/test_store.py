from tessera.operators import store as S
from tessera.schema import CHUNKS, FILES
from tessera.streaming import ingest as I


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([("/a", "h", 1, 1, 1, "r", 5), ("/b", "h", 1, 1, 1, None, 9)], FILES)
    new = spark.createDataFrame([("/b", "h2", 2, 3, "r"), ("/b", "h1", 1, 3, "r"), ("/d", "x", 1, 1, "r"), ("/c", "x", 1, 1, None)], "path string, hash string, last_modified long, size long, project_root string")
    got = {r["path"]: (r["id"], r["hash"], r["is_indexed"]) for r in S.upsert_files(old, new).collect()}
    assert got == {"/a": (5, "h", 1), "/b": (9, "h2", 0), "/c": (10, "x", 0), "/d": (11, "x", 0)}
    empty = spark.createDataFrame([], FILES)
    assert sorted(r["id"] for r in S.upsert_files(empty, new).collect()) == [1, 2, 3]


def test_numbers_are_dense(spark):
    df = spark.range(1000).selectExpr("hash(id) as k", "id").repartition(7)
    got = [r["n"] for r in S.number_rows(df, ["k", "id"], "n").orderBy("k", "id").collect()]
    assert got == list(range(1, 1001))


def test_links(spark):
    c = spark.createDataFrame([(1, 7, 1, 9), (2, 7, 2, 4), (3, 8, 1, 1)], "id long, file_id long, start_line int, end_line int")
    calls = spark.createDataFrame([(7, 3, "f"), (7, 3, "f"), (7, 8, "g"), (8, 5, "h")], "file_id long, line int, name string")
    assert sorted(tuple(r)[:2] for r in S.first_chunk_links(c, calls).collect()) == [(1, "f"), (1, "f"), (1, "g"), (3, "h")]
    assert sorted(tuple(r)[:2] for r in S.innermost_links(c, calls).collect()) == [(1, "g"), (2, "f"), (2, "f")]


def test_migration_and_commit(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "s"))
    assert s.table("files").count() == 0
    old = spark.createDataFrame([(1, 1, "text", 1, 2, [0.5])], "id long, file_id long, content string, start_line int, end_line int, embedding array<float>")
    s.commit({"chunks": old})
    r = s.table("chunks").first()
    assert s.table("chunks").schema.names == CHUNKS.names and r["symbol_name"] is None and r["content"] == "text"
    s.commit({"chunks": s.table("chunks").unionByName(s.table("chunks"))})
    folders = lambda: {x.name for x in (tmp_path / "s").iterdir() if x.is_dir() and x.name != "log"}
    before = s.table("chunks")
    assert before.count() == 2 and len(folders()) == 2  # the version that readers may have planned on stays
    s.commit({"chunks": s.table("chunks").limit(1)})
    assert s.table("chunks").count() == 1 and before.count() == 2 and len(folders()) == 2


def test_changes_of_a_store(spark, tmp_path):
    s = S.Store(spark, "file://" + str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "path string, id long")
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    s.change({"files": rows(("/a", 1), ("/b", 2))})
    s.change({"files": rows(("/b", 2), ("/c", 3))}, {"files": paths("/b", "/x")}, ("events", 4))
    assert sorted((r["path"], r["id"]) for r in s.table("files").collect()) == [("/a", 1), ("/b", 2), ("/c", 3)]
    s.change({"files": rows(("/d", 9))}, None, ("events", 4))  # a repeated batch
    assert s.table("files").count() == 3 and s.applied("events") == 4 and s.applied("other") == -1
    for k in range(S.Store.SEGMENTS + 3):  # an old row, and one that each change replaces; the table is written anew in between
        s.change({"files": rows(("/a", k))}, {"files": paths("/a")})
        assert sorted((r["path"], r["id"]) for r in s.table("files").collect()) == [("/a", k), ("/b", 2), ("/c", 3)]
    assert len(s.versions()["files"]["segments"]) < S.Store.SEGMENTS
    other = S.Store(spark, str(tmp_path / "s"))
    now = other.entry()
    s.change({"files": rows(("/e", 5))})
    import pytest

    with pytest.raises(Exception, match="exist"):
        other._log(now, now["tables"], None)  # another commit was first


def test_shared_folder_and_stages(spark, tmp_path):
    import types

    import pytest

    from tessera import session

    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master)))
    assert session.shared_dir(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: "hdfs://x/y/"), sparkContext=None)) == "hdfs://x/y"
    with session.stages(spark):
        df = session.materialize(spark.range(3))
        path = df.inputFiles()[0].rsplit("/", 1)[0].replace("file://", "")
        assert df.count() == 3
    import os

    assert not os.path.exists(path)
    one = spark.range(10).coalesce(1)
    one.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(one).rdd.getNumPartitions() > 1 == one.rdd.getNumPartitions()
    spark.conf.set("spark.tessera.spread", "0")
    try:
        assert session.spread(one).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.tessera.spread")


def test_all_names_are_listed(spark, tmp_path):
    from tessera.sources.scan import IGNORE_FILE, ignore_globs, scan_tree

    for name in ("a.py", "__init__.py", "_x/b.py", ".config/c.json", "build/d.py", "src/.hidden/_e.py", "empty.txt", "sub dir/%41 é.py"):
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("" if name == "empty.txt" else name)
    (tmp_path / "r" / "link").symlink_to(tmp_path / "r", target_is_directory=True)
    got = {r["path"][len(str(tmp_path)) + 3 :]: bytes(r["content"]).decode() for r in scan_tree(spark, str(tmp_path / "r")).collect()}
    assert got == {n: n for n in ("a.py", "__init__.py", "_x/b.py", ".config/c.json", "src/.hidden/_e.py", "sub dir/%41 é.py")} | {"empty.txt": ""}
    (tmp_path / IGNORE_FILE).write_text("# names\n_x\n *.json\n")
    got = {r["path"].rsplit("/", 1)[1] for r in scan_tree(spark, "file://" + str(tmp_path / "r"), ignore_globs(str(tmp_path)), with_content=False).collect()}
    assert got == {"a.py", "__init__.py", "_e.py", "empty.txt", "%41 é.py"}
    assert scan_tree(spark, str(tmp_path / "none")).count() == 0


def test_deep_trees_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    from tessera.sources import scan

    monkeypatch.setattr(scan, "FOLDERS", 3)
    for k in range(12):
        p = tmp_path / f"d{k % 4}" / f"e{k % 3}" / "f" / f"{k}.py"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    assert scan.list_tree(spark, str(tmp_path)).select("path").distinct().count() == 12


def test_changes(spark):
    files = spark.createDataFrame([("/a", "h", 1, 1, 1, "r", 5), ("/b", "h", 1, 1, 0, None, 9)], FILES)
    seen = spark.createDataFrame([("/a", 1, 1, "h"), ("/b", 1, 1, "h"), ("/c", 1, 1, "h")], "path string, size long, last_modified long, hash string")
    assert {r["path"] for r in S.changed_by_metadata(seen, files).collect()} == {"/b", "/c"}
    assert {r["path"] for r in S.changed_by_hash(seen, files).collect()} == {"/c"}


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/file_events.parquet")
    e.repartition(6).write.parquet(str(tmp_path / "in"))
    state = {"s": spark.createDataFrame([], "path string, event_type string, ts timestamp_ntz")}

    def apply(batch, n):
        rows = I.merge_state(state["s"], batch).collect()
        state["s"] = spark.createDataFrame(rows, state["s"].schema)

    I.run_stream(I.event_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "cp"), apply)
    assert {(r[0], r[2]) for r in state["s"].collect()} == {(r[0], r[2]) for r in I.latest_events(e).collect()}


def test_stream_windows(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/file_events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = I.event_counts(I.event_stream(spark, str(tmp_path / "in")), late="4000 days").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from windows").collect()} == {tuple(r) for r in I.event_counts(e).collect()}


def test_file_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.py", "b.py"):
        (tmp_path / "in" / n).write_text("x = 1\n")
    seen = []
    I.run_stream(I.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda b, n: seen.extend(r["path"].rsplit("/", 1)[1] for r in b.collect()))
    (tmp_path / "in" / "c.py").write_text("x = 2\n")
    I.run_stream(I.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda b, n: seen.extend(r["path"].rsplit("/", 1)[1] for r in b.collect()))
    assert sorted(seen) == ["a.py", "b.py", "c.py"]


def test_roots_and_ignores(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text as X
    from tessera.sources.scan import assign_root, snapshot_events

    r = spark.createDataFrame([(1, "/a/b"), (2, "/a"), (3, "/c")], "ordinal int, root string")
    p = spark.createDataFrame([("/a/bc/x",), ("/a/x",), ("/d",)], "path string")
    assert {x["path"]: x["project_root"] for x in assign_root(p, r).collect()} == {"/a/bc/x": "/a/b", "/a/x": "/a", "/d": None}
    names = spark.createDataFrame([("/r/build/x.py",), ("/r/src/x.o",), ("/r/src/x.py",), ("/r/builder/x",), ("/r/.git/c",)], "p string")
    assert {x[0] for x in names.filter(~X.ignored(F.col("p"), F.lit("/r"), X.IGNORED)).collect()} == {"/r/src/x.py", "/r/builder/x"}
    assert X.parse_ignore_file("# a\n\n  *.tmp \nbuild\n") == ["*.tmp", "build"]
    s = "path string, size long, last_modified long"
    a, b = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1), ("/c", 1, 1)], s), spark.createDataFrame([("/a", 1, 1), ("/b", 2, 1), ("/d", 1, 1)], s)
    assert {tuple(x) for x in snapshot_events(a, b).collect()} == {("/b", "Modified"), ("/c", "Deleted"), ("/d", "Created")}
