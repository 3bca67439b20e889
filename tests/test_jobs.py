import json
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import config, evaluate_retrieval, ingest_documents
from jobs.catalog import ORACLES, QUERIES
from tests.conftest import DATA
from tests.oracle import differences

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_second_run_leaves_the_result(spark, name):
    assert not differences(spark, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001")


def test_settings(tmp_path):
    for job in (ingest_documents, evaluate_retrieval):
        own = Path(job.__file__)
        assert config.load(job.Config, own.with_suffix(".json")) == job.Config()
    (tmp_path / "x.json").write_text(json.dumps({"chunk_sizes": 3}))
    with pytest.raises(ValueError, match="chunk_sizes"):
        config.load(ingest_documents.Config, tmp_path / "x.json")


# ---- ingest ----


@pytest.fixture
def parts(spark, tmp_path):
    """A growing copy of the documents: grow(k) adds the k-th of three parts."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    folder = tmp_path / "documents.parquet"
    folder.mkdir()

    def grow(k: int, rows=None):
        (docs.where(f"doc_id % 3 = {k}") if rows is None else rows).coalesce(1).write.mode("append").parquet(f"file://{folder}")

    return grow, f"file://{folder}", f"file://{tmp_path}/kb", f"file://{tmp_path}/kb/checkpoint"


def held(spark, out):
    return sorted(map(tuple, ingest_documents.chunks(spark, out).drop("batch").collect()), key=repr)


def hashes(spark, folder):
    cut = ingest_documents.chunk_documents(spark.read.parquet(folder), 200, 40, "token", keep=("doc_id",))
    return {r[0] for r in cut.select("content_hash").collect()}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_takes_only_what_is_new(spark, parts, monkeypatch, broadcast):
    monkeypatch.setattr(ingest_documents, "BROADCAST_HASHES", broadcast)
    grow, folder, out, checkpoint = parts
    grow(0)
    first = ingest_documents.ingest(spark, folder, out, checkpoint)
    one = held(spark, out)
    assert [d["batch"] for d in first] == [0] and first[0]["written"] == len(one) == first[0]["chunks"]
    assert ingest_documents.ingest(spark, folder, out, checkpoint) == [] and held(spark, out) == one
    grow(1)
    second = ingest_documents.ingest(spark, folder, out, checkpoint)
    docs = spark.read.parquet(folder)
    assert [d["batch"] for d in second] == [1] and second[0]["read"] == docs.where("doc_id % 3 = 1").count()
    both = held(spark, out)
    assert set(one) < set(both) and len(both) == len(one) + second[0]["written"]
    assert len({r[4] for r in both}) == len(both) and {r[4] for r in both} == hashes(spark, folder)
    # the same documents again, in a new file: chunks that are known are not written twice
    grow(None, docs.where("doc_id % 3 = 0").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    third = ingest_documents.ingest(spark, folder, out, checkpoint)
    assert third[0]["written"] == 0 < third[0]["chunks"] and held(spark, out) == both


def test_failed_batch_is_run_again(spark, parts, monkeypatch):
    grow, folder, out, checkpoint = parts
    grow(0)
    ingest_documents.ingest(spark, folder, out, checkpoint)
    grow(1)
    grow(2)
    whole = ingest_documents.add

    def breaks(*args):
        whole(*args)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(ingest_documents, "add", breaks)
    with pytest.raises(Exception, match="lost after the write"):
        ingest_documents.ingest(spark, folder, out, checkpoint)
    monkeypatch.setattr(ingest_documents, "add", whole)
    ingest_documents.ingest(spark, folder, out, checkpoint)
    got = held(spark, out)
    assert len({r[4] for r in got}) == len(got) and {r[4] for r in got} == hashes(spark, folder)


def test_batches_of_files(spark, parts):
    grow, folder, out, checkpoint = parts
    for k in range(3):
        grow(k)
    done = ingest_documents.ingest(spark, folder, out, checkpoint, ingest_documents.Config(files_per_batch=1))
    assert [d["batch"] for d in done] == [0, 1, 2]
    assert {r[4] for r in held(spark, out)} == hashes(spark, folder)


def test_nulls_and_no_rows(spark, parts):
    grow, folder, out, checkpoint = parts
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    grow(None, spark.createDataFrame([], kind))
    ingest_documents.ingest(spark, folder, out, checkpoint)
    assert held(spark, out) == []
    grow(None, spark.createDataFrame([(None, "some text", None, None, 1), (1, None, "en", "s", 0), (2, "some  text", "en", "s", 0), (3, "", "a/b=c", "s", 0), (4, "odd", "a/b=c", "s", 3)], kind))
    ingest_documents.ingest(spark, folder, out, checkpoint)
    assert [(r[0], r[1], r[3], r[6]) for r in held(spark, out)] == [(4, "s", "odd", "a/b=c"), (None, None, "some text", None)]


# ---- evaluation ----


def test_labels_stand_side_by_side(spark, tmp_path):
    out = f"file://{tmp_path}/evaluation"
    folder = f"{DATA}/sf0.001"
    run = lambda label, docs=folder, **own: evaluate_retrieval.evaluate(spark, f"{docs}/documents.parquet", f"{folder}/benchmark.parquet", out, evaluate_retrieval.Config(label=label, **own))
    rows = lambda: sorted(map(tuple, evaluate_retrieval.questions(spark, out).collect()), key=repr)
    first = run("monday")
    one = rows()
    assert first["total"] == len(one) > 0
    assert run("monday") == first and rows() == one
    run("tuesday", top_k=1, threshold=0.99)
    both = rows()
    assert len(both) == 2 * len(one) and [r for r in both if "monday" in r] == one
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    none = run("tuesday", docs=f"file://{tmp_path}/none")
    assert none["total"] == 0 and rows() == one
    assert {r["label"]: r["total"] for r in evaluate_retrieval.totals(spark, out).collect()} == {"monday": len(one), "tuesday": 0}
    with pytest.raises(ValueError, match="label"):
        run("a/b")


def test_command_lines(tmp_path):
    env = {"PATH": "/usr/bin:/bin:" + str(Path(sys.executable).parent), "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    submit = [sys.executable, "-m"]
    folder = f"{DATA}/sf0.001"
    done = subprocess.run([*submit, "jobs.ingest_documents", "--documents", f"{folder}/documents.parquet", "--out", str(tmp_path / "kb"), "--checkpoint", str(tmp_path / "mark")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "chunks written" in done.stdout and list((tmp_path / "kb/chunks/batch=0").glob("lang=*/*.parquet"))
    done = subprocess.run([*submit, "jobs.evaluate_retrieval", "--documents", f"{folder}/documents.parquet", "--questions", f"{folder}/benchmark.parquet", "--out", str(tmp_path / "ev")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "questions written under nightly" in done.stdout and list((tmp_path / "ev/questions/label=nightly").glob("source_hit=*/*.parquet"))


def test_index_is_kept_while_documents_stay(spark, tmp_path):
    """A rerun embeds and inverts nothing; a changed table is indexed anew, with the results of a first run."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    out, folder, asked = f"file://{tmp_path}/evaluation", f"file://{tmp_path}/documents.parquet", f"{DATA}/sf0.001/benchmark.parquet"
    files = lambda: sorted(p.name for p in (tmp_path / "evaluation/index/label=nightly").glob("[pv]*/*.parquet"))
    rows = lambda at: sorted(map(tuple, evaluate_retrieval.questions(spark, at).collect()), key=repr)
    docs.where("doc_id % 2 = 0").write.parquet(folder)
    evaluate_retrieval.evaluate(spark, folder, asked, out)
    one, first = files(), rows(out)
    evaluate_retrieval.evaluate(spark, folder, asked, out)
    assert one and files() == one and rows(out) == first
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(folder)
    evaluate_retrieval.evaluate(spark, folder, asked, out)
    evaluate_retrieval.evaluate(spark, folder, asked, f"{out}-new")
    assert not set(files()) & set(one) and rows(out) == rows(f"{out}-new") != first
