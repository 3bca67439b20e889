"""The engine: ingest files, ask questions, manage the chunk store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.pii import mask_text
from lodestone.log import get_logger
from lodestone.operators import bm25
from lodestone.operators.embed import Embedder, HashingEmbedder, Progress, warm_up
from lodestone.operators.evaluate import hit_rates, hits
from lodestone.operators.fusion import Reranker
from lodestone.operators.retrieval import hybrid_retrieve
from lodestone.operators.store import ChunkStore
from lodestone.plans.agent import Answerer, Chat
from lodestone.plans.runtime import prepare, scratch
from lodestone.retry import retry_with_backoff
from lodestone.sources.files import load_chunks, read_files, uploads
from lodestone.sources.ocr import OCRProvider
from lodestone.sources.registry import describe


log = get_logger("lodestone.engine")


@dataclass(frozen=True)
class IngestResult:
    added: int
    skipped_duplicates: int
    total_chunks: int


@dataclass(frozen=True)
class AskResult:
    answer: str
    sources: list[dict]
    mode: str


def default_root(spark: SparkSession, settings: Settings) -> str:
    """The settings' store folder. A relative one is another folder on each machine of a cluster, so only a local session
    may use it."""
    if not spark.sparkContext.master.startswith("local") and "://" not in settings.chroma_dir and not settings.chroma_dir.startswith("/"):
        raise RuntimeError(f"name a store folder that the driver and all executors share, not {settings.chroma_dir}")
    return settings.chroma_dir


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, settings: Settings | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, chat: Chat | None = None, ocr: OCRProvider | None = None, tokenizer: Callable[[Column], Column] = bm25.tokens):
        self.spark, self.settings = prepare(spark), settings or Settings()
        self.embedder, self.reranker, self.ocr = embedder or HashingEmbedder(), reranker, ocr
        self.store = ChunkStore(spark, root or default_root(spark, self.settings), self.embedder, self.settings.collection_name, tokenizer)
        self._chat = retry_with_backoff(max_retries=3)(chat) if chat else None

    def warm_up(self) -> None:
        """Load the models and the search index, so that the first question does not wait for them."""
        warm_up(self.embedder, self.reranker)
        self.store.collection()
        log.info("ready: %d chunks", self.store.count())

    # ---- documents ----

    def ingest(self, paths: list[str], names: list[str] | None = None, progress: Progress | None = None) -> IngestResult:
        """Add files; progress(done, total) is called as chunks are embedded."""
        return self._ingest(read_files(self.spark, paths), names, progress)

    def ingest_bytes(self, files: list[tuple[str, bytes]], progress: Progress | None = None) -> IngestResult:
        if not files:
            raise ValueError("no files given")
        return self._ingest(uploads(self.spark, files), None, progress)

    def _ingest(self, files: DataFrame, names: list[str] | None, progress: Progress | None) -> IngestResult:
        seen = Observation()
        with scratch():
            _, kept = load_chunks(files, self.settings, self.ocr, names=names, seen=seen)
            added = self.store.add(kept, progress)
            got = IngestResult(added, seen.get["chunks"] - added, self.store.count())
        log.info("ingest: %d added or replaced, %d skipped, %d in all", got.added, got.skipped_duplicates, got.total_chunks)
        return got

    def list_sources(self) -> DataFrame:
        return self.store.sources()

    def delete_source(self, source: str) -> dict:
        if not source:
            raise ValueError("source must not be empty")
        deleted, left = self.store.delete_source(source)
        return {"deleted_chunks": deleted, "total_chunks": left}

    def clear(self) -> dict:
        self.store.clear()
        return {"total_chunks": 0}

    def supported_types(self) -> dict:
        return describe(self.settings)

    def health(self) -> dict:
        return {"status": "ok", "total_chunks": self.store.count()}

    # ---- questions ----

    def retrieve(self, queries: DataFrame, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        """queries (query_id, text) to query_id, rank, text, source, score: one plan for all."""
        return hybrid_retrieve(self.store.collection(), queries, self.embedder, top_k, threshold, self.reranker, self.settings)

    def search(self, questions: list[str], top_k: int | None = None, threshold: float | None = None) -> list[list[dict]]:
        queries = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
        out: list[list[dict]] = [[] for _ in questions]
        with scratch():
            rows = self.retrieve(queries, top_k, threshold).orderBy("query_id", "rank").collect()  # top_k rows for each question
        for r in rows:
            out[r["query_id"]].append({"text": r["text"], "source": r["source"], "score": r["score"]})
        return out

    def ask(self, question: str, mode: str = "rag", history: list[dict] | None = None, top_k: int | None = None, threshold: float | None = None, enable_hyde: bool | None = None, enable_pii: bool | None = None) -> AskResult:
        """Answer with sources; any mode but `agent` is one round. Personal data is masked in the question, the history,
        the prompt, the answer and the sources' texts, but not in the store or in source names."""
        return self.ask_many([question], mode, [history or []], top_k, threshold, enable_hyde, enable_pii)[0]

    def ask_many(self, questions: list[str], mode: str = "rag", histories: list[list[dict]] | None = None, top_k: int | None = None, threshold: float | None = None, enable_hyde: bool | None = None, enable_pii: bool | None = None) -> list[AskResult]:
        """ask() for many questions, whose retrievals are one plan for each round."""
        if not all(questions):
            raise ValueError("question must not be empty")
        if top_k is not None and not 1 <= top_k <= 20:
            raise ValueError("top_k must be from 1 to 20")
        if threshold is not None and not 0 <= threshold <= 1:
            raise ValueError("threshold must be from 0 to 1")
        if self._chat is None:
            raise RuntimeError("no language model was given")
        s = self.settings
        masking = s.enable_pii if enable_pii is None else enable_pii
        mask = (lambda t: mask_text(t)[0]) if masking else (lambda t: t)
        answerer = Answerer(self._chat, lambda qs: self.search(qs, top_k, threshold), mask, s.summary_max_tokens, s.summary_keep_recent, s.enable_hyde if enable_hyde is None else enable_hyde)
        begin = answerer.agent_steps if mode == "agent" else answerer.rag_steps
        steps = []
        for question, history in zip(questions, histories or [[]] * len(questions), strict=True):
            past = [m | {"content": mask(m["content"])} if isinstance(m.get("content"), str) else dict(m) for m in history]
            steps.append(begin(mask(question), past))
        return [AskResult(mask(got["answer"]), [d | {"text": mask(d["text"])} for d in got["sources"]], mode) for got in answerer.run(steps)]

    # ---- evaluation ----

    def evaluate(self, cases: DataFrame, top_k: int = 3) -> dict:
        """cases as evaluate.load_cases gives them."""
        with scratch():
            return hit_rates(hits(cases, self.retrieve(cases.select("query_id", "text"), top_k))).first().asDict()

    def ingest_samples(self, paths: list[str]) -> int:
        """Clear the store, then add every file by itself."""
        self.clear()
        return sum(self.ingest([p]).added for p in paths)


def sources_markdown(sources: list[dict]) -> str:
    """Sources as Markdown, for display."""
    return "\n\n".join(f"**[{i}] {d['source']}** (score {d['score']})\n\n{d['text']}" for i, d in enumerate(sources, 1)) or "no sources"


def views(engine: Engine) -> None:
    """Temp views `chunks` and `sources` for SQL."""
    engine.store.read().createOrReplaceTempView("chunks")
    engine.list_sources().select("source", F.col("chunks")).createOrReplaceTempView("sources")
