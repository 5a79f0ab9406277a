"""The engine's entry points: ingest a folder, retrieve for questions, answer over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemming, text
from ..operators import fusion, lexical, search
from ..operators.shared import written
from ..sources import readers
from ..sources.catalog import Catalog
from ..sources.store import ChunkStore
from . import algebra, routing, rules, writing

# What a score is made of.
PARTS = ["dense", "bm25", "rrf", "key_boost", "meta_boost", "hint_boost"]
# Labels of a computed result, the first that applies.
FAILED, EMPTY, UNVERIFIED, TRUNCATED, EXACT = "service_failure", "empty", "unverified", "truncated", "exact"


class Engine:
    """embed(texts) -> vectors; score_pairs(queries, contents) -> scores; write_plan(prompt) -> steps
    of the plan algebra; check(prompt) -> verdict. All but embed are optional."""

    def __init__(self, spark: SparkSession, store: ChunkStore, embed, catalog: Catalog | None = None, score_pairs=None, write_plan=None, check=None):
        self.spark, self.store, self.embed, self.catalog = spark, store, embed, catalog or Catalog(spark)
        self.score_pairs, self.write_plan, self.check = score_pairs, write_plan, check
        self.index = lexical.LexicalStore(spark, f"{store.path.rstrip('/')}.index") if store is not None else None

    def ingest(self, folder: str, force: bool = False, extract=None) -> DataFrame:
        """Put the documents of a folder in the store; sources that it has are passed over without force.
        extract: gives the pages of a PDF file, if there are any. Returns the catalogue of sources."""
        found = [readers.read_txt_chunks, readers.read_json_chunks, readers.read_jsonl_chunks, readers.read_docx_chunks]
        for read in found:
            self.store.ingest(read(self.spark, folder), force, self.embed)
        if extract is not None:
            pages = readers.read_pages(self.spark, folder, extract)
            self.store.ingest(pages.select("source", F.col("first").alias("seq"), "content", "page_info"), force, self.embed)
        return self.store.sources()

    def _gates(self, questions: DataFrame, source: str | None) -> DataFrame:
        """(qid, meta, hint): whether a question is about the data sets themselves (by its route, or because it
        names a column), and the data set that a question about data sets fits best."""
        routed = routing.route(questions, self.catalog.columns())
        about = (F.col("target") == routing.META) | (F.col("reason") == "schema_or_doc_conceptual") | F.col("strong")
        gates = routed.select("qid", about.alias("meta"), (F.col("target") == routing.META).alias("wants_hint"))
        if source is not None or not self.catalog.columns():
            return gates.select("qid", "meta", F.lit(None).cast("string").alias("hint"))
        best = self.catalog.ranked(questions).where("rank = 1 and score > 0").select("qid", "dataset")
        return gates.join(best, "qid", "left").select("qid", "meta", F.when(F.col("wants_hint"), F.col("dataset")).alias("hint"))

    def retrieve(self, questions: DataFrame, top_k: int = search.TOP_K, final: int = search.RERANK_TOP_N, source: str | None = None, dense_slot: int = 0, meta: bool | None = None, parts: bool = False) -> DataFrame:
        """(qid, rank, chunk_id, source, page_info, content, score) for questions (qid, question).

        source: search in one source only, with that source's statistics. meta: whether the questions are about
        the data sets, so that chunks that describe them are lifted; by default each question's route tells.
        A question about data sets also lifts the chunks of the one that it fits best. dense_slot: nearest
        chunks by vector that join the pool before reranking. parts: with what the score is made of (dense,
        bm25, rrf, key_boost, meta_boost, hint_boost). A chunk without a vector is found by its words alone;
        vectors of another length than the store's are an error.
        """
        self.index.refresh(self.store)
        chunks = self.store.read().withColumn("meta", search.is_meta(F.col("page_info")))
        sources = None
        if source is not None:
            wanted = text.normalize(F.element_at(F.split("source", "/"), -1)) == text.normalize(F.lit(source.strip()))
            sources = [r[0] for r in chunks.where(wanted).select("source").distinct().collect()]  # as many as share the name
            chunks = chunks.where(F.col("source").isin(sources))
        stored = chunks.where("embedding is not null").select(F.size("embedding")).first()
        told = questions.join(self._gates(questions, source), "qid").select("qid", "question", F.col("meta").alias("meta_gate"), "hint")
        index, out, block = self.index.open(sources), None, []
        for row in [*told.toLocalIterator(), None]:  # a block of questions travels as one matrix of vectors
            block += [row] if row is not None else []
            if block and (row is None or len(block) == fusion.QUESTIONS):
                part = self._answer(index, chunks, block, stored, top_k, final, dense_slot, meta, parts)
                out = part if out is None else out.unionByName(part)
                block = []
        if out is not None:
            return out
        shown = ["qid long", "rank int", "chunk_id long", "source string", "page_info string", "content string", "score double", *[f"{x} double" for x in PARTS] * parts]
        return self.spark.createDataFrame([], ", ".join(shown))

    def _answer(self, index, chunks: DataFrame, block: list, stored, top_k: int, final: int, dense_slot: int, meta: bool | None, parts: bool) -> DataFrame:
        vectors = self.embed([r["question"] or "" for r in block])
        if stored and stored[0] != len(vectors[0]):
            raise ValueError(f"vectors of {len(vectors[0])} values cannot be compared with the store's, which have {stored[0]}")
        asked = [fusion.Question(r["qid"], list(v), bool(r["meta_gate"]) if meta is None else meta, r["hint"]) for r, v in zip(block, vectors)]
        questions = self.spark.createDataFrame([(r["qid"], r["question"]) for r in block], "qid long, question string")
        query = written(stemming.search_tokens(questions, "question").select("qid", "tokens"), "questions")
        words = written(lexical.scores(index, query), "lexical")

        def coverage(rows: DataFrame) -> DataFrame:
            held = stemming.search_tokens(chunks.join(rows.select("chunk_id").distinct(), "chunk_id").select("chunk_id", text.key_values(F.col("content")).alias("values")), "values")
            key = held.select("chunk_id", F.explode(F.array_distinct("tokens")).alias("token"))
            return lexical.coverage(index, query, key)(rows)

        scored = fusion.fuse(chunks.select("chunk_id", "embedding", "source", "meta"), words, asked, top_k, coverage, dense_slot)
        scored = written(scored, "scored")
        pool = search.top_k(scored, top_k).select("qid", "chunk_id", "rank")
        if dense_slot and self.score_pairs is not None:
            near = scored.where("dense is not null").select("qid", "chunk_id", F.col("dense").alias("score"))
            pool = search.with_dense_slot(pool, near, dense_slot)
        made_of = PARTS if parts else []
        details = pool.join(scored.select("qid", "chunk_id", "score", *made_of), ["qid", "chunk_id"]).join(chunks.select("chunk_id", "source", "page_info", "content"), "chunk_id")
        shown = ["qid", "rank", "chunk_id", "source", "page_info", "content", "score", *made_of]
        if self.score_pairs is None:
            return details.where(F.col("rank") <= final).select(*shown)
        pairs = details.drop("rank", "score").join(questions.select("qid", F.col("question").alias("query")), "qid")
        return search.rerank(pairs, self.score_pairs, final).select(*shown)

    def answer_table(self, question: str, dataset: str | None = None) -> dict:
        """{"route", "dataset", "reason", "label", "rows"}: by the rules, else by a written plan.

        A computed answer has n_rows, too, the number of all its rows; where "rows" holds only the first of
        them, truncated is true and the label is not exact."""
        name, reason = (dataset, "selected") if dataset else self.catalog.choose(question)
        q = self.spark.createDataFrame([(0, question)], "qid long, question string")
        route = routing.route(q, self.catalog.columns(), F.lit(dataset is not None)).first()
        out = {"route": route["target"], "dataset": name, "reason": reason, "rows": []}
        if name is None:
            return out | {"label": FAILED}
        table = self.catalog.tables[name]
        roles = rules.bind(table)
        roles.statistics = self.catalog.metadata.get(name, {}).get("statistics", {})
        if route["target"] in (routing.RULES, routing.META):
            result = rules.execute(question, table, roles)
            if result is not None:
                rows, n_rows = algebra.bounded(result)
                cut = n_rows > len(rows)
                return out | {"label": TRUNCATED if cut else EXACT if rows else EMPTY, "rows": rows, "n_rows": n_rows, "truncated": cut}
        if self.write_plan is None:
            return out | {"label": FAILED}
        ran = writing.answer(self.write_plan, table, question, self.check)
        if "error" in ran:
            return out | {"label": FAILED, "error": ran["error"]}
        label = EMPTY if ran["status"] == "empty" else UNVERIFIED if ran["validation"] == "objection" else TRUNCATED if ran["truncated"] else EXACT
        return out | {"label": label, **{k: ran[k] for k in ("rows", "n_rows", "truncated", "attempts", "validation", "validation_error")}, "objection": ran.get("objection")}
