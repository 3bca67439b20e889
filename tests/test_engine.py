import json
import random
import re
import threading
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.engine import Engine, sources_markdown
from lodestone.operators import bm25
from lodestone.operators import store as store_module
from lodestone.operators.conversation import compress, compress_messages
from lodestone.operators.embed import HashingEmbedder
from lodestone.operators.retrieval import ranges_of, with_text
from lodestone.operators.store import ChunkStore
from lodestone.plans.agent import Answerer, first_seen, parse_json
from lodestone.plans.runtime import materialize, release, scratch, shared_dir
from lodestone.retry import delay, retry_with_backoff
from lodestone.streaming.ingest import ingest_stream

HANDBOOK = "公司员工手册\n\n报销流程：员工提交报销单，主管审批后由财务付款。\n\n年假：工作满一年的员工每年有五天年假。"
FAQ = "产品常见问题\n\n误删的文件可以在回收站恢复，保留三十天。\n\n铂金会员有两百吉字节的存储空间。"
CASES = [
    ("公司的报销流程是怎样的？", "公司员工手册.txt", "报销"),
    ("年假有几天？", "公司员工手册.txt", "年假"),
    ("误删的文件还能恢复吗？", "产品常见问题FAQ.txt", "恢复"),
    ("铂金会员有多少存储空间？", "产品常见问题FAQ.txt", "存储空间"),
]


@pytest.fixture
def engine(spark, tmp_path):
    settings = Settings(chunk_size=40, chunk_overlap=0)
    e = Engine(spark, str(tmp_path / "store"), settings, chat=lambda m: "answer to me@x.org")
    e.ingest_bytes([("公司员工手册.txt", HANDBOOK.encode()), ("产品常见问题FAQ.txt", FAQ.encode("gbk"))])
    return e


def test_golden_questions(spark, engine):
    cases = spark.createDataFrame([(i, q, [s], [k]) for i, (q, s, k) in enumerate(CASES)], "query_id long, text string, expected_sources array<string>, expected_keywords array<string>")
    assert engine.evaluate(cases) == {"total": 4, "source_hits": 4, "keyword_hits": 4, "passed": True}
    for (question, source, _), found in zip(CASES, engine.search([c[0] for c in CASES], top_k=3, threshold=0.0), strict=True):
        assert found[0]["source"] == source, question


def test_store(spark, engine):
    before, at = engine.health()["total_chunks"], engine.store.revision
    again = engine.ingest_bytes([("copy.txt", HANDBOOK.encode())])
    assert again.total_chunks == before and engine.store.revision == at + 1
    assert "公司员工手册.txt" not in {r["source"] for r in engine.list_sources().collect()}  # the last batch owns the chunks
    assert engine.delete_source("none") == {"deleted_chunks": 0, "total_chunks": before} and engine.store.revision == at + 2
    assert engine.delete_source("copy.txt")["deleted_chunks"] == again.added
    ids = [r["id"] for r in engine.store.read().collect()]
    assert len(set(ids)) == len(ids)
    engine.clear()
    assert engine.health()["total_chunks"] == 0 and engine.search(["年假"]) == [[]]
    assert engine.ingest_bytes([("blank.txt", b" \n ")]).added == 0 and engine.store.revision == at + 4


def test_store_in_segments(spark, tmp_path, monkeypatch):
    """Against a dictionary: upserts keep places, deletes count, searches see live rows only; segments merge."""
    rng = random.Random(3)
    monkeypatch.setattr(store_module, "MOST_SEGMENTS", 4)
    store = ChunkStore(spark, str(tmp_path), HashingEmbedder(8), keep_seconds=0)
    live, n_place, merged = {}, 0, 0
    for turn in range(9):
        if turn in (4, 7):
            source = f"s{rng.randrange(3)}"
            gone = [h for h, r in live.items() if r[1] == source]
            assert store.delete_source(source) == (len(gone), len(live) - len(gone))
            for h in gone:
                del live[h]
        else:
            rows = []
            for i, h in enumerate(rng.sample(range(40), 9)):
                source = f"s{rng.randrange(3)}"
                rows.append((f"word{h} text{turn}", source, i, f"h{h}", 0))
            store.add(spark.createDataFrame(rows, "text string, source string, chunk_index int, content_hash string, file_no int"))
            for text, source, i, h, _ in rows:
                place = live[h][3] if h in live else (n_place, source, i)
                live[h] = (text, source, i, place)
            n_place += 1
        got = sorted(store.read().collect(), key=lambda r: r["id"])
        assert [(r["chunk_id"], r["text"], r["source"], r["chunk_index"]) for r in got] == [(h, *r[:3]) for h, r in sorted(live.items(), key=lambda x: x[1][3])]
        assert store.count() == len(live) and store.revision == turn + 1 and len({r["id"] for r in got}) == len(got)
        merged += len(store._manifest()["segments"]) == 1 and turn > 1
        ask = spark.createDataFrame([(1, "word7 text2 word3")], "query_id long, text string")
        found = bm25.search(store.collection().index, ask, 50).join(store.read(), "id").select("chunk_id", "score").collect()
        plain = bm25.bm25_topk(store.read().select("id", "text"), ask, 50).join(store.read(), "id").select("chunk_id", "score").collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, plain))
    assert merged
    named = {s["name"] for r in store._revisions() for s in store._manifest(r)["segments"]}
    assert len(store._revisions()) == 2 and set(store._names("segments")) == set(store._names("keys")) == named
    assert store.read(store._revisions()[0]).count() == store._alive(store._manifest(store._revisions()[0]))


def test_second_search_reads_no_texts(spark, engine):
    engine.search(["年假"])
    held = engine.store.collection()
    assert engine.store.collection() is held
    files = bm25.search(held.index, spark.createDataFrame([(0, "年假")], "query_id long, text string"), 5).inputFiles()
    assert files and all("/index/" in f and "/postings/" in f for f in files)
    written = engine.store._names("index")
    engine.search(["报销"])
    assert engine.store._names("index") == written


def test_tokenizer_is_handed_in(spark, tmp_path):
    """A segmenter that knows two words: whole words match, single characters do not."""
    cut = lambda t: [w for w in re.split("(年假|报销)", t) for w in ([w] if w in ("年假", "报销") else w.split())]
    e = Engine(spark, str(tmp_path / "s"), Settings(chunk_size=40, chunk_overlap=0), tokenizer=bm25.cut_by(cut))
    e.ingest_bytes([(f"{i}.txt", t.encode()) for i, t in enumerate(("年假 五天", "年 假期 三天", "报销 流程", "其他 内容", "更多 内容"))])
    index = e.store.collection().index
    assert {"年假", "报销"} <= {r["tok"] for r in index.vocabulary.collect()} and index.n == 5
    asked = spark.createDataFrame([(0, "年假")], "query_id long, text string")
    found = bm25.search(index, asked, 9, e.store.tokenizer).join(e.store.read(), "id").collect()
    assert [r["text"] for r in found] == ["年假 五天"]
    assert e.search(["年假"], top_k=1)[0]


def chunks_of(spark, *rows):
    return spark.createDataFrame([(t, s, i, h) for i, (h, t, s) in enumerate(rows)], "text string, source string, chunk_index int, content_hash string")


def contents(store):
    return {r["chunk_id"]: (r["text"], r["source"], r["id"]) for r in store.read().collect()}


def test_late_commit_is_refused(spark, engine):
    late = engine.store._manifest()
    engine.delete_source("none")
    with pytest.raises(store_module.Conflict):
        engine.store._commit(late | {"revision": late["revision"] + 1})
    assert not [n for n in engine.store._names("manifests") if n.endswith(".part")]


def overtaken(store, other, monkeypatch):
    """The next commit of store comes after other() has committed."""
    commit, called = store._commit, []

    def late(new):
        if not called:
            called.append(other())
        commit(new)

    monkeypatch.setattr(store, "_commit", late)


def test_overtaken_add_keeps_both(spark, tmp_path, monkeypatch):
    """A writer that read the manifest before another one committed; both bring a key that was there, one a key of both."""
    mine, other = (ChunkStore(spark, str(tmp_path), HashingEmbedder(8)) for _ in range(2))
    mine.add(chunks_of(spark, ("k1", "one", "a"), ("k2", "two", "a")))
    first = contents(mine)
    overtaken(mine, lambda: other.add(chunks_of(spark, ("c1", "theirs", "c"), ("k1", "theirs too", "c"), ("both", "theirs both", "c"))), monkeypatch)
    mine.add(chunks_of(spark, ("d1", "mine", "d"), ("k1", "mine too", "d"), ("both", "mine both", "d")))
    got = contents(mine)
    assert {h: x[:2] for h, x in got.items()} == {"k1": ("mine too", "d"), "k2": ("two", "a"), "c1": ("theirs", "c"), "both": ("mine both", "d"), "d1": ("mine", "d")}
    assert got["k1"][2] == first["k1"][2] and len({x[2] for x in got.values()}) == 5 == mine.count() and got["both"][2] < got["d1"][2]
    assert mine.revision == 3 and contents(ChunkStore(spark, str(tmp_path), HashingEmbedder(8))) == got


@pytest.mark.parametrize("change", ["delete", "clear", "merge"])
def test_overtaken_by_other_changes(spark, tmp_path, monkeypatch, change):
    mine, other = (ChunkStore(spark, str(tmp_path), HashingEmbedder(8), keep_seconds=3600) for _ in range(2))
    for k in range(3):
        mine.add(chunks_of(spark, (f"a{k}", "one", "a"), (f"b{k}", "two", "b")))
    if change == "merge":
        monkeypatch.setattr(store_module, "MOST_SEGMENTS", 3)
    act = {"delete": lambda: other.delete_source("a"), "clear": other.clear, "merge": lambda: other.add(chunks_of(spark, ("x", "x", "x")))}[change]
    overtaken(mine, act, monkeypatch)
    mine.add(chunks_of(spark, ("a0", "new", "n"), ("y", "y", "n")))
    kept = {"delete": {"b0", "b1", "b2"}, "clear": set(), "merge": {"a1", "a2", "b0", "b1", "b2", "x"}}[change]
    got = contents(mine)
    assert set(got) == kept | {"a0", "y"} and got["a0"][:2] == ("new", "n") and mine.count() == len(got)


def test_overtaken_delete(spark, tmp_path, monkeypatch):
    mine, other = (ChunkStore(spark, str(tmp_path), HashingEmbedder(8)) for _ in range(2))
    mine.add(chunks_of(spark, ("a0", "one", "a"), ("b0", "two", "b")))
    overtaken(mine, lambda: other.add(chunks_of(spark, ("a1", "late", "a"), ("b1", "two", "b"))), monkeypatch)
    assert mine.delete_source("a") == (2, 2) and set(contents(mine)) == {"b0", "b1"}


def test_writers_at_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), HashingEmbedder(8))
    failed = []

    def write(k):
        try:
            ChunkStore(spark, str(tmp_path), HashingEmbedder(8)).add(chunks_of(spark, *((f"{k}-{i}", f"text {k} {i}", f"s{k}") for i in range(5)), ("shared", f"by {k}", f"s{k}")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    got = contents(store)
    assert not failed and store.revision == 4 and len(got) == 21 == store.count() == len({x[2] for x in got.values()})


def test_fetch_by_id_reads_few_pages(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), HashingEmbedder(2))
    store.add(spark.range(3000).selectExpr("array_join(transform(sequence(1, 12), i -> sha2(concat(id, '-', i), 512)), '') AS text", "'s' AS source", "int(id) AS chunk_index", "concat('h', id) AS content_hash"))
    chunks = store.read().select("id", "text", "source")
    ids = [r["id"] for r in chunks.select("id").orderBy("id").collect()]
    wanted = [ids[k] for k in (5, 6, 7, 1500, 2990)]
    ranked = spark.createDataFrame([(i, n) for n, i in enumerate(wanted)], "id long, rank int")
    found = with_text(ranked, chunks)
    got = found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    while plan.nodeName() in ("AdaptiveSparkPlan", "ResultQueryStage"):
        plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).nodeName().startswith("Scan")]
    rows = sum(x.metrics().apply("numOutputRows").value() for x in scans)  # rows of the pages that are read
    assert scans and rows < 0.3 * 3000
    assert sorted(r["id"] for r in got) == sorted(wanted)
    assert ranges_of([7, 5, 6, 100, 7], 2) == [(5, 7), (100, 100)] and ranges_of([1, 2, 3], 5) == [(1, 3)] and ranges_of([9]) == [(9, 9)] and ranges_of([1, 9, 20], 1) == [(1, 20)]


def test_small_upsert_reads_few_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "BUCKET_KEYS", 16)
    store = ChunkStore(spark, str(tmp_path), HashingEmbedder(2))
    store.add(spark.range(2000).selectExpr("concat('t', id) AS text", "'s' AS source", "int(id) AS chunk_index", "concat('h', id) AS content_hash"))
    (segment,) = store._manifest()["segments"]
    assert segment["digits"] == 2
    new = chunks_of(spark, *((f"h{i}", "again", "n") for i in range(5)), *((f"x{i}", "fresh", "n") for i in range(3)))
    keys = new.select(F.col("content_hash").alias("chunk_id"))
    size = lambda df: sum(Path(f.removeprefix("file://")).stat().st_size for (f,) in df.select(F.input_file_name()).distinct().collect())
    assert size(store._asked(segment, keys, 8)) < 0.05 * size(store._keys(segment))
    assert size(store._asked(segment, keys, 300)) == size(store._keys(segment))
    assert store._known(store._manifest(), keys, 8).count() == 5
    store.add(new)
    assert store.count() == 2003


def test_progress_and_warm_up(spark, tmp_path):
    seen = []
    e = Engine(spark, str(tmp_path / "s"), Settings(chunk_size=20, chunk_overlap=0))
    got = e.ingest_bytes([(f"{i}.txt", f"text number {i}, with a few words".encode()) for i in range(20)], progress=lambda a, b: seen.append((a, b)))
    assert seen[-1] == (got.added, got.added) and all(0 < a <= b for a, b in seen) and sorted(seen) == seen
    e.warm_up()
    assert e.store._names("index")

    class Lazy(HashingEmbedder):
        loaded = 0

        def model(self):
            Lazy.loaded += 1

    Engine(spark, str(tmp_path / "t"), embedder=Lazy()).warm_up()
    assert Lazy.loaded == 1


class CountingOCR:
    def __init__(self, folder):
        self.folder = folder

    def extract_image_bytes(self, content, mime_type):
        (self.folder / uuid.uuid4().hex).write_text(mime_type)
        return f"text of {content.decode()}"


def test_files_are_parsed_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    e = Engine(spark, str(tmp_path / "s"), Settings(enable_ocr=True), ocr=CountingOCR(calls))
    assert e.ingest_bytes([("a.png", b"one"), ("b.png", b"two")]).added == 2
    assert len(list(calls.iterdir())) == 2
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("c", "d"):
        (folder / f"{name}.png").write_bytes(name.encode())
    ingest_stream(e, str(folder), str(tmp_path / "cp")).awaitTermination(120)
    assert len(list(calls.iterdir())) == 4 and e.health()["total_chunks"] == 4


def test_scratch_tables_are_deleted(spark, tmp_path):
    made = []
    with scratch() as keep:
        a, b = (materialize(spark.range(3), "t") for _ in range(2))
        made = [x._lodestone_path.removeprefix("file://") for x in (a, keep(b))]
    assert [Path(p).exists() for p in made] == [False, True]
    release(b)
    assert not Path(made[1]).exists()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, *a: None})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_ask(engine):
    seen = []
    engine._chat = lambda m: seen.append(m) or "call 13812345678"
    got = engine.ask("年假 me@x.org?", history=[{"role": "user", "content": "13912345678"}])
    assert got.answer == "call [PHONE]" and got.sources and got.mode == "rag"
    assert "[EMAIL]" in seen[-1][-1]["content"] and seen[-1][1]["content"] == "[PHONE]"
    for bad in ({"question": ""}, {"question": "q", "top_k": 21}, {"question": "q", "threshold": 2}):
        with pytest.raises(ValueError):
            engine.ask(**bad)
    assert engine.supported_types()["chunking"]["chunk_size"] == 40
    assert sources_markdown([]) == "no sources" and "手册" in sources_markdown(engine.search(["年假"])[0])


def scripted(*replies):
    left = list(replies)
    return lambda messages: left.pop(0)


def agent(chat, docs):
    return Answerer(chat, lambda qs: [[{"text": f"{q}/{d}", "source": "s", "score": 1.0} for d in docs] for q in qs], lambda t: t)


def test_agent_flow():
    assert agent(scripted('{"need_retrieve": false}', "hello"), "a").agent("hi", []) == {"answer": "hello", "sources": []}
    a = agent(scripted("not json", json.dumps({"sub_questions": ["p", "q", "r", "s"]}), '{"enough": false, "follow_up": "more"}', '{"enough": false, "follow_up": "again"}', "done"), "ab")
    got = a.agent("q?", [])
    assert got["answer"] == "done" and [d["text"] for d in got["sources"]] == ["p/a", "p/b", "q/a", "q/b", "r/a", "r/b", "more/a", "more/b"]
    assert a.trace == ["round 1: 6", "round 2: 8"]
    assert agent(scripted("{}", "{}", "none found"), "").agent("q", [])["answer"] == "none found"
    a = agent(scripted("{}", '{"sub_questions": "x"}', '{"enough": false, "follow_up": ""}', "ok"), "a")
    assert [d["text"] for d in a.agent("q", [])["sources"]] == ["q/a"]


def test_hyde():
    a = agent(scripted("passage ", "answer"), "a")
    a.enable_hyde = True
    assert a.rag("q", [])["sources"][0]["text"] == "q\npassage/a"

    def broken(messages):
        raise OSError

    b = agent(broken, "a")
    b.enable_hyde = True
    assert b.search_text("q") == "q"


def test_small_helpers():
    assert parse_json('x {"a": 1} y') == {"a": 1} and parse_json("{a}") is None and parse_json("") is None
    assert [d["text"] for d in first_seen([{"text": "a"}, {"text": "b"}, {"text": "a"}])] == ["a", "b"]
    assert all(0 <= delay(n) <= 39 for n in range(1, 12)) and 0.7 <= delay(1) <= 1.3
    calls, slept = [], []

    @retry_with_backoff(max_retries=2, sleep=slept.append)
    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        fails()
    assert len(calls) == 3 and len(slept) == 2


def test_compression_agrees(spark):
    rng = random.Random(6)
    for keep in (0, 1, 3):
        talks = [[{"role": rng.choice(["user", "assistant", "system"]), "content": "汉word " * rng.randrange(30)} for _ in range(rng.randrange(1, 9))] for _ in range(40)]
        rows = [(i, t, m["role"], m["content"]) for i, talk in enumerate(talks) for t, m in enumerate(talk)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {}
        for r in compress(df, 120, keep).orderBy("conv_id", "position").collect():
            got.setdefault(r["conv_id"], []).append({"role": r["role"], "content": r["text"]})
        assert got == {i: compress_messages(talk, 120, keep) for i, talk in enumerate(talks)}
    assert compress_messages([{"role": "user", "content": "x" * 99}] * 5, 10, 1, lambda h: 1 / 0)[0]["content"].startswith("【历史对话摘要】")


def test_streaming(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), Settings())
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("first file")
    for name in ("b.txt", "c.txt"):
        ingest_stream(e, str(folder), str(tmp_path / "cp")).awaitTermination(120)
        (folder / name).write_text("first file" if name == "b.txt" else "other")
    ingest_stream(e, str(folder), str(tmp_path / "cp")).awaitTermination(120)
    assert e.health()["total_chunks"] == 2
