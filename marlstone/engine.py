"""The engine's front: build an index from tables, ask it a batch of questions, evaluate the answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULTS, Settings
from .functions.rules import is_off_topic
from .lineage import cut_lineage, scope
from .models import Chat, Embedder, complete, embed_column, extractive_chat, hashed_embedder
from .operators import evaluation
from .operators.chunking import detect_references, document_chunks, first_wins, image_chunks, link_chunks, restricted_chunks, union_chunks
from .operators.context import context_text, sources
from .operators.conversation import standalone
from .operators.dense import dense_topk
from .operators.hybrid import expand_references, fuse, with_fallback
from .operators.sparse import packed_vectors, sparse_topk

APOLOGY, GREETING = "No matching passage was found.", "Ask me about the documents."


class Engine:
    """Chunks, vectors and retrieval over one set of tables."""

    def __init__(self, spark: SparkSession, cfg: Settings = DEFAULTS, embedder: Embedder | None = None, chat: Chat = extractive_chat, rewriter: Chat | None = None, hints: dict[str, str] | None = None) -> None:
        if bad := cfg.validate():
            raise ValueError(f"settings out of range: {bad}")
        self.spark, self.cfg, self.embedder, self.chat = spark, cfg, embedder or hashed_embedder(cfg.dimension), chat
        self.rewriters, self.hints = [("rewriter", rewriter)] if rewriter else None, hints
        self.chunks: DataFrame | None = None
        self.terms: DataFrame | None = None

    def build_index(self, documents: DataFrame, images: DataFrame | None = None, links: DataFrame | None = None, restricted: DataFrame | None = None) -> DataFrame:
        """Chunks of all sources, each id once, with dense vectors and hashed terms; written once and read back."""
        parts = {"document": document_chunks(documents, "doc_id", "text", "doc_title", "source_url", self.cfg).withColumn("src", F.format_string("%020d", "doc_id")).drop("doc_id")}
        if images is not None:
            parts["image"] = image_chunks(images)
        if links is not None:
            parts["reference_link"] = link_chunks(links)
        if restricted is not None:
            parts["restricted_doc"] = restricted_chunks(restricted)
        every = union_chunks(**parts)
        for name in ("link_text", "what_it_contains", "when_to_refer", "note", "image_file", "image_content"):
            if name not in every.columns:
                every = every.withColumn(name, F.lit(None).cast("string"))
        every = every.withColumn("link_url", F.when(F.col("chunk_type").isin("reference_link", "restricted_doc"), F.col("source_url")))
        kept = first_wins(every, "chunk_id", "source_rank", "src", F.asc_nulls_last("ord"))
        with scope() as keep:
            kept = cut_lineage(kept)
            refs = detect_references(kept, "chunk_id", "content", kept, "section", self.cfg)
            self.chunks = keep(embed_column(kept.join(refs, "chunk_id"), "embed_text", "embedding", self.embedder))
            self.terms = keep(packed_vectors(self.chunks, "chunk_id", "embed_text", self.cfg.buckets))
        return self.chunks

    def retrieve(self, questions: DataFrame, qid: str, text: str, k: int | None = None) -> DataFrame:
        """(qid, chunk_id, fused, raw, rank) of the best chunks of every question."""
        k = k or self.cfg.candidates
        asked = cut_lineage(embed_column(questions.select(qid, F.col(text).alias("q")), "q", "embedding", self.embedder))
        d = dense_topk(asked, self.chunks, qid, "chunk_id", "embedding", k, block_bytes=self.cfg.broadcast_bytes)
        s = sparse_topk(packed_vectors(asked, qid, "q", self.cfg.buckets), self.terms, qid, "chunk_id", k, block_bytes=self.cfg.broadcast_bytes)
        return fuse(d, s, qid, "chunk_id", self.cfg)

    def expand(self, ranked: DataFrame, qid: str) -> DataFrame:
        """(qid, chunk_id): chunks of the sections that the best chunks refer to and that are not among them; ``ranked`` has qid, chunk_id."""
        return expand_references(ranked, self.chunks, qid, "chunk_id")

    def smoke_search(self, questions: DataFrame, qid: str, text: str, k: int = 3) -> DataFrame:
        """(qid, chunk_id, score, rank): dense search alone, to see that a new index answers."""
        asked = embed_column(questions.select(qid, F.col(text).alias("q")), "q", "embedding", self.embedder)
        return dense_topk(asked, self.chunks, qid, "chunk_id", "embedding", k, block_bytes=self.cfg.broadcast_bytes)

    def ask(self, questions: DataFrame) -> DataFrame:
        """(id, answer, context, sources, branch, related) of (id, question, history): a batch plan of the whole path.

        ``related`` holds the chunks that the cited ones refer to.  The answers are written once; what was written on the way
        is deleted before they are returned.
        """
        with scope() as keep:
            return keep(self._answers(questions))

    def _answers(self, questions: DataFrame) -> DataFrame:
        cfg = self.cfg
        q = questions.select("id", "question", "history")
        small_talk = q.where(is_off_topic(F.col("question"))).select("id", F.lit(GREETING).alias("answer"), F.lit("").alias("context"), F.lit("[]").alias("sources"), F.lit("off_topic").alias("branch"), F.array().cast("array<string>").alias("related"))
        real = cut_lineage(q.where(~is_off_topic(F.col("question"))).withColumn("standalone", standalone(F.col("history"), F.col("question"), self.rewriters, self.hints, cfg)))
        first = cut_lineage(self.retrieve(real, "id", "standalone"))
        broad = cut_lineage(self.retrieve(real, "id", "question", cfg.broad_candidates))
        best = with_fallback(first, broad, "id", cfg).where(F.col("rank") <= cfg.context_chunks)
        ranked = cut_lineage(best.join(self.chunks.drop("embedding"), "chunk_id"))
        cited = sources(ranked, "id", cfg).groupBy("id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc", "section", "url", "kind"))), lambda x: x)).alias("sources"))
        branch = best.groupBy("id").agg(F.min("branch").alias("branch"))
        related = self.expand(ranked, "id").groupBy("id").agg(F.array_sort(F.collect_list("chunk_id")).alias("related"))
        full = real.join(context_text(ranked, "id"), "id", "left").join(cited, "id", "left").join(branch, "id", "left").join(related, "id", "left")
        reply = complete(F.concat_ws("\n\n", "question", "context"), [("stand-in", self.chat)])
        full = cut_lineage(full.withColumn("r", reply))
        answered = full.select("id", F.when(F.col("context").isNull(), APOLOGY).otherwise(F.coalesce("r.text", F.lit(APOLOGY))).alias("answer"), F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", F.lit("[]")).alias("sources"), F.coalesce("branch", F.lit("none")).alias("branch"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))
        return answered.unionByName(small_talk)

    def stream_answer(self, question: str, history: list[dict[str, str]] | None = None) -> Iterator[str]:
        """Event lines of one answer: status, tokens, sources, done."""
        rows = self.spark.createDataFrame([("1", question, history or [])], "id string, question string, history array<struct<role: string, content: string>>")
        line = lambda kind, text: "data: " + json.dumps({"type": kind, "text": text}, ensure_ascii=False) + "\n\n"
        yield line("status", "searching")
        try:
            with scope():
                row = self.ask(rows).first()
        except Exception as e:
            yield line("error", str(e)[:200])
            return
        for w in row["answer"].split(" "):
            yield line("token", w + " ")
        yield line("sources", row["sources"])
        yield line("done", "")

    def evaluate(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(checks per question, scores per chunk type, topic and over all)."""
        answers = cut_lineage(self.ask(questions).select("id", "answer", "sources"))
        checked = evaluation.checks(questions.join(answers, "id", "left"))
        return checked, evaluation.scores(checked)
