"""A small project from files to answers."""

import json
import os

import pytest

from tessera.api import Engine, ToolServer
from tessera.config import Config
from tessera.functions.embedders import HashEmbedder, RemoteEmbedder, ZeroEmbedder, choose_backend, embedder_of, openai_embedder
from tessera.functions.wordpiece import encode


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "src").mkdir()
    (root / "docs").mkdir()
    (root / "node_modules").mkdir()
    (root / "src" / "ledger.py").write_text("class Ledger:\n    def post(self, amount):\n        return record(amount)\n\n    def undo(self):\n        return record(0)\n\ndef record(value):\n    return value\n")
    (root / "README.md").write_text("# Notes\n\nThe flamingo keeps the books.\n")
    (root / "docs" / "plan.txt").write_text("A plan about tides.\n")
    (root / "node_modules" / "x.js").write_text("function hidden() { return 1; }\n")
    (root / "data.bin").write_bytes(b"\x00\x01")
    e = Engine(spark, str(tmp_path_factory.mktemp("index")), Config(embedding_backend="hash"), HashEmbedder(32))
    e.root = str(root)
    assert e.watch_add(str(root)).startswith("added")
    return e


def test_counts_and_resources(engine):
    s = json.loads(engine.call('{"method": "status"}'))["result"]
    assert s["total_files"] == 3 and s["total_chunks"] == s["memory_items"] >= 5
    assert engine.watch_add(engine.root) == "already watched"
    assert engine.scan(engine.root) == 0
    paths = json.loads(engine.call('{"method": "resource_list"}'))["result"]
    assert sorted(map(os.path.basename, paths)) == ["README.md", "ledger.py", "plan.txt"]
    assert "flamingo" in engine.resource_read("tessera://" + next(p for p in paths if p.endswith("README.md")))
    assert engine.resource_read("tessera:///etc/hostname") is None


def test_queries(engine):
    assert any(r["symbol_name"] == "Ledger" for r in engine.query("Ledger").collect())
    assert all(r["symbol_type"] == "function" for r in engine.query("record", 5, "function").collect())
    assert "flamingo" in engine.query("flamingo").first()["content"]
    assert engine.query("undo", 5, "", "python").count() > 0
    assert not any("undo" in r["content"] for r in engine.query("undo", 5, "", "cpp").collect())
    assert {r["type"] for r in engine.query("record").collect()} == {"hybrid"}


def test_lookups(engine):
    refs = json.loads(engine.call('{"method": "find_references", "params": ["record"]}'))["result"]
    assert len(refs) == 2
    d = json.loads(engine.call('{"method": "get_definition", "params": ["record"]}'))["result"]
    assert d["symbol_type"] == "function"
    path = next(p for p in json.loads(engine.call('{"method": "resource_list"}'))["result"] if p.endswith(".py"))
    s = json.loads(engine.call(json.dumps({"method": "list_symbols", "params": [path]})))["result"]
    assert [x["name"] for x in s] == ["Ledger", "post", "undo", "record"]
    assert len(json.loads(engine.call(json.dumps({"method": "summarize_project", "params": [engine.root]})))["result"]) == 4


def test_keyword_only(engine, spark):
    e = Engine(spark, engine.folder, Config(memory_mode="DISK"), engine.embedder)
    assert {r["type"] for r in e.query("record").collect()} == {"keyword"}
    e = Engine(spark, engine.folder, Config(), ZeroEmbedder())
    assert e.query("flamingo").count() == 1


def test_errors(engine):
    assert json.loads(engine.call("no json")) == {"error": "error"} == json.loads(engine.call('{"method": "watch_add", "params": ["/no/such"]}'))
    assert json.loads(engine.call('{"method": "dance"}')) == {"error": "unknown"}
    assert json.loads(engine.call('{"method": "ping"}')) == {"result": "pong"}


def test_tools(engine):
    t = ToolServer(engine)
    ask = lambda m, **p: json.loads(t.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p})))
    assert ask("initialize")["result"]["protocolVersion"] and len(ask("tools/list")["result"]["tools"]) == 7
    assert len(ask("resources/list")["result"]["resources"]) == 3
    assert ask("resources/read", uri="tessera:///none")["error"]["code"] == -32002
    assert "flamingo" in ask("tools/call", name="query", arguments={"query": "flamingo"})["result"]["content"][0]["text"]
    assert ask("tools/call", name="dance")["error"]["code"] == -32601
    assert t.handle('{"method": "notifications/initialized"}') is None is t.handle('{"method": "other"}')
    assert json.loads(ToolServer(None).handle('{"id": 1, "method": "tools/call", "params": {"name": "status"}}'))["error"]["code"] == -32001


def test_change_and_delete(engine):
    p = os.path.join(engine.root, "docs", "plan.txt")
    with open(p, "w") as f:
        f.write("A plan about herons and more.\n")
    os.remove(os.path.join(engine.root, "README.md"))
    assert engine.scan(engine.root) == 1
    assert engine.query("herons").count() and not any("tides" in r["content"] for r in engine.query("tides").collect())
    assert not any("flamingo" in r["content"] for r in engine.query("flamingo").collect())
    assert engine.reindex() == 2


def test_only_the_difference_is_written(engine, spark):
    before = {n: len(v["segments"]) for n, v in engine.store.versions().items()}
    with open(os.path.join(engine.root, "docs", "__init__.py"), "w") as f:
        f.write("def gannet():\n    return record(7)\n")
    assert engine.scan(engine.root) == 1 and engine.query("gannet").count()
    v = engine.store.versions()
    assert all(len(v[n]["segments"]) <= before[n] + 1 for n in v)
    assert len(engine.store.table("files").filter("is_indexed = 1").collect()) == 3
    assert engine.store.table("chunks").groupBy("id").count().filter("count > 1").isEmpty() and engine.store.table("symbol_links").groupBy("id").count().filter("count > 1").isEmpty()
    os.remove(os.path.join(engine.root, "docs", "__init__.py"))
    engine.scan(engine.root)
    assert not any("gannet" in r["content"] for r in engine.query("gannet").collect())


def project(tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    (root / "a.py").write_text("def avocet():\n    return 1\n")
    (root / "b.txt").write_text("notes about bitterns\n")
    return root


def test_live(spark, tmp_path):
    import time

    root = project(tmp_path)
    e = Engine(spark, str(tmp_path / "i"), Config(embedding_backend="hash"), live=True)
    e.watch_add(str(root))

    def until(test):
        end = time.time() + 90
        while not test():
            assert time.time() < end
            time.sleep(0.5)

    paths = lambda: {os.path.basename(x["path"]) for x in e.resource_list().collect()}
    assert paths() == {"a.py", "b.txt"} and e.watch().isActive
    (root / "a.py").write_text("def curlew(x):\n    return avocet(x)\n")  # an edit, a rename, a new file in a new folder
    (root / "b.txt").rename(root / "c.txt")
    (root / "d").mkdir()
    (root / "d" / "_e.md").write_text("dunlins\n")
    until(lambda: paths() == {"a.py", "c.txt", "_e.md"} and e.store.table("chunks").filter("symbol_name = 'curlew'").count() == 1)
    e.shutdown()
    assert not spark.streams.active
    (root / "c.txt").unlink()  # while nothing runs
    again = Engine(spark, str(tmp_path / "i"), live=True)
    assert again.config.watch_paths == [str(root)]
    again.embedder = e.embedder
    again.watch()
    until(lambda: {os.path.basename(x["path"]) for x in again.resource_list().collect()} == {"a.py", "_e.md"})
    again.shutdown()


def test_events(spark, tmp_path):
    import datetime

    root = project(tmp_path)
    e = Engine(spark, str(tmp_path / "i"), Config(embedding_backend="hash"))
    e.watch_add(str(root))
    (root / "a.py").rename(root / "z.py")
    (root / "b.txt").write_text("notes about bitterns and more\n")
    at = datetime.datetime(2026, 1, 1)
    rows = [(str(root / n), k, at + datetime.timedelta(seconds=s), at) for n, k, s in (("a.py", "Modified", 0), ("a.py", "Renamed", 1), ("z.py", "Created", 1), ("b.txt", "Modified", 2), ("b.txt", "Modified", 2), ("gone.py", "Created", 3))]
    rows.append(("/elsewhere/x.py", "Created", at, at))
    from tessera.streaming.ingest import EVENTS, event_stream

    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        e.follow(event_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "cp"))
        assert {os.path.basename(x["path"]) for x in e.resource_list().collect()} == {"z.py", "b.txt"}
    n = e.store.entry()["number"]
    assert e.apply_events(spark.createDataFrame(rows, EVENTS), ("events", 0)) == 0 and e.store.entry()["number"] == n
    assert [r["content"] for r in e.store.table("chunks").filter("symbol_name = ''").collect()] == ["notes about bitterns and more\n"]


def test_another_dimension(spark, tmp_path):
    root = project(tmp_path)
    e = Engine(spark, str(tmp_path / "i"), Config(embedding_backend="hash"), HashEmbedder(16))
    e.watch_add(str(root))
    same = Engine(spark, str(tmp_path / "i"), embedder=HashEmbedder(16))
    assert not same.check_dimension() and same.scan(str(root)) == 0
    silent = Engine(spark, str(tmp_path / "i"), embedder=RemoteEmbedder("m", transport=lambda *a: {}))
    assert not silent.check_dimension() and e.store.table("chunks").count() == 2
    other = Engine(spark, str(tmp_path / "i"), embedder=HashEmbedder(24))
    assert other.check_dimension() and other.store.table("chunks").count() == 0 and other.store.table("files").filter("is_indexed = 1").count() == 0
    assert other.scan(str(root)) == 2 and {len(r["embedding"]) for r in other.store.table("chunks").collect()} == {24}


def test_each_text_is_embedded_once(spark, tmp_path):
    root = project(tmp_path)
    calls = tmp_path / "calls"
    calls.mkdir()

    def transport(url, body, headers):
        import uuid

        (calls / uuid.uuid4().hex).write_text(body["prompt"])
        return {"embedding": [1.0, 2.0]}

    e = Engine(spark, str(tmp_path / "i"), embedder=RemoteEmbedder("m", transport=transport, size=2))
    e.watch_add(str(root))
    assert sorted(p.read_text() for p in calls.iterdir()) == sorted(r["content"] for r in e.store.table("chunks").collect())


def test_missing_vectors(spark, tmp_path):
    root = project(tmp_path)
    e = Engine(spark, str(tmp_path / "i"), embedder=RemoteEmbedder("m", transport=lambda *a: {}))
    e.watch_add(str(root))
    assert e.store.table("chunks").filter("embedding is null").count() == 2 and e.embed_missing() == 0
    e.embedder = HashEmbedder(8)
    assert e.embed_missing() == 2 and e.store.table("chunks").filter("size(embedding) = 8").count() == 2


def test_config(tmp_path):
    p = str(tmp_path / "c.json")
    Config(memory_mode="DISK", watch_paths=["/a"]).save(p)
    assert Config.load(p) == Config(memory_mode="DISK", watch_paths=["/a"])
    (tmp_path / "c.json").write_text('{"memory_mode": "OTHER", "hybrid_limit": "many", "embedding_model": "m"}')
    assert Config.load(p) == Config(embedding_model="m") and Config.load("/no/file") == Config()


def test_back_ends():
    assert choose_backend("openai", {"OPENAI_API_KEY": "k"}) == ("openai", "k")
    assert choose_backend("none", {}) == ("none", "")
    assert choose_backend("ollama", {}, exists=lambda p: True, data_dir="/m") == ("onnx", "/m")
    assert choose_backend("ollama", {}, exists=lambda p: False, reachable=lambda: True)[0] == "ollama"
    r = RemoteEmbedder("m", transport=lambda u, b, h: {"embedding": [1, 2]})
    assert r.dimension() == 2 and r.embed("x") == [1.0, 2.0]
    assert openai_embedder("k", transport=lambda u, b, h: {"data": [{"embedding": [float(h["Authorization"] == "Bearer k")]}]}).embed("x") == [1.0]
    calls = []

    def fail(*a):
        calls.append(a)
        if len(calls) < 3:
            raise OSError
        return {"embedding": [5]}

    assert RemoteEmbedder("m", transport=fail, wait=0.01).embed("x") == [5.0] and len(calls) == 3
    assert RemoteEmbedder("m", transport=lambda *a: 1 / 0, wait=0.01).embed("x") == []
    assert RemoteEmbedder("m", transport=lambda u, b, h: {"embedding": [len(b["prompt"])]}).embed_all(["a", "bb"]) == [[1.0], [2.0]]
    kind = lambda *a, **k: type(embedder_of(*a, env={}, reachable=lambda: False, **k)).__name__
    assert [kind(b, "m") for b in ("hash", "none", "ollama", "openai")] == ["HashEmbedder", "ZeroEmbedder", "RemoteEmbedder", "RemoteEmbedder"]
    assert embedder_of("openai", "m", "key", env={}).key == "key"


def test_local_model(tmp_path, spark):
    """A model file as a local back end takes it: the mean over the tokens of a table's rows."""
    onnx = pytest.importorskip("onnxruntime")
    from tessera.functions.embedders import OnnxEmbedder, embedder_of as of

    (tmp_path / "vocab.txt").write_text("\n".join(["[PAD]", *[f"u{k}" for k in range(99)], "[UNK]", "[CLS]", "[SEP]", "play"]) + "\n")
    (tmp_path / "model.onnx").write_bytes(b"not a model")
    e = of("onnx", "m", data_dir=str(tmp_path), env={})
    assert isinstance(e, OnnxEmbedder) and e.vocab["play"] == 103 and e.embed("play") == []
    class Session:
        def run(self, names, feed):
            import numpy as np

            assert names == ["last_hidden_state"] and feed["input_ids"].tolist() == [[101, 103, 102]] and feed["attention_mask"].tolist() == [[1, 1, 1]]
            return [np.array([[[3.0, 0.0], [3.0, 0.0], [0.0, 8.0]]])]

    e._session = Session()
    import math

    assert onnx and all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(e.embed("play"), [0.6, 0.8]))


def test_wordpiece():
    v = {w: k for k, w in enumerate(["[PAD]", *[f"u{k}" for k in range(99)], "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "it", "##s"])}
    assert encode("Playing, it's!", v) == [101, v["play"], v["##ing"], v["it"], v["##s"], 102]
    assert encode("zebra", v) == [101, 100, 102] and encode("x" * 101, v) == [101, v["[UNK]"], 102] and encode(None, v) == [101, 102]
    assert len(encode("play " * 600, v)) == 512


def test_page(engine):
    from urllib.request import urlopen

    from tessera.web import serve, stats

    server = serve(engine, 0)
    url = f"http://127.0.0.1:{server.server_address[1]}"
    assert stats(url)["total_files"] >= 2 and b"/api/stats" in urlopen(url + "/").read()
    server.shutdown()
