"""One query for each operator or group of operators, each over its whole tables.

Conventions for what the tables do not have: a document is a chunk; the items of
``benchmark`` are questions; for dense and hybrid retrieval, vectors and documents of
one id belong together, rows whose id is divisible by 50 ask, a question's text is
its document's first line, and its gold chunk is that document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.cases import ANSWER_CASES, UNANSWERABLE
from tessera.config import DEFAULTS, REFUSAL
from tessera.functions import pii, text
from tessera.operators import answers, conversations, evaluation, router, store
from tessera.operators.bm25 import bm25_top_k, corpus_stats, term_stats
from tessera.operators.chunking import chunk_pages, hashed_embedder, register_chunkers
from tessera.operators.dense import dense_top_k
from tessera.operators.dense_index import DenseIndex
from tessera.operators.embedder import DIM, fit_embedder
from tessera.operators.posting_index import PostingIndex
from tessera.operators.rerank import alone, blended, lexical_overlap, partial_rerank, rerank, rerank_by_interaction, term_weights
from tessera.plans.chat import chat
from tessera.plans.ingest import embedded
from tessera.plans.retrieval import BENCHMARK, answer, respond, retrieve, sweep
from tessera.shared import shared_path, written
from tessera.sources.readers import read_text_table
from tessera.sources.sinks import exposition
from tessera.streaming.limiter import rate_limit
from tessera.streaming.live import request_counters, request_totals, requests_in_flight, windowed_counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
INTENTS = [str(i) for i in range(10)]
#: Exemplars of an intent, as in the router's bank of sentences.
EXEMPLARS = 28


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def shared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents as chunks, the vectors of those that have one, and the questions among them; those without a vector ask the sparse side alone."""
    chunks = documents(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id").withColumn("page", F.lit(1))
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    asked = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.get(F.split("text", "\n"), 0).alias("query"))
    return chunks, vectors, written(asked.join(vectors.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), "query_id", "left"), "asked")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def top_documents(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, query, rank, chunk_id, text, source, page): the k best documents of every question."""
    docs, asked = documents(spark, sf_dir), questions(spark, sf_dir)
    best = bm25_top_k(docs, asked, k)
    return best.join(docs.select(F.col("doc_id").alias("chunk_id"), "text", "source"), "chunk_id").join(asked, "query_id").withColumn("page", F.lit(1))


# --- sparse, dense, hybrid retrieval -------------------------------------------


@query
def bm25_topk(spark, sf_dir):
    return rounded(bm25_top_k(documents(spark, sf_dir), questions(spark, sf_dir), 10), "score")


@query
def bm25_scoped_docids(spark, sf_dir):
    docs = documents(spark, sf_dir)
    allowed = docs.where("lang = 'de'").select(F.col("doc_id").alias("chunk_id"))
    return rounded(bm25_top_k(docs, questions(spark, sf_dir), 5, allowed=allowed), "score")


@query
def bm25_incremental(spark, sf_dir):
    """A stored index after three additions, the last of which replaces texts, a deletion and merges."""
    docs = documents(spark, sf_dir)
    index = PostingIndex(spark, shared_path(spark, "postings"))
    first = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    index.add(docs.where(first), id_col="doc_id")
    index.add(docs.where(~first), id_col="doc_id")
    index.add(docs.where("lang = 'es'").withColumn("text", F.concat_ws(" ", "text", "source")), id_col="doc_id")
    index.delete(docs.where("lang = 'fr'").select("doc_id"))
    index.compact()
    return rounded(index.top_k(questions(spark, sf_dir), 10), "score")


@query
def bm25_term_stats(spark, sf_dir):
    return rounded(term_stats(documents(spark, sf_dir)), "idf")


@query
def bm25_corpus_stats(spark, sf_dir):
    return rounded(corpus_stats(documents(spark, sf_dir)), "avgdl")


@query
def dense_topk(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    return rounded(dense_top_k(v, v.where("vec_id % 50 = 0"), 20, skip_self=True), "score")


@query
def dense_scoped(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    allowed = v.where("label = 3").select(F.col("vec_id").alias("chunk_id"))
    return rounded(dense_top_k(v, v.where("vec_id % 50 = 0"), 5, allowed=allowed), "score")


@query
def dense_ivf_topk(spark, sf_dir):
    """The approximate index, with its numbers fitted for the recall of 0.95; no SQL, as what it misses depends on them."""
    v = load(spark, sf_dir, "embeddings")
    return rounded(DenseIndex.build(v).search(v.where("vec_id % 50 = 0"), 20, skip_self=True), "score")


@query
def dense_ivf_recall(spark, sf_dir):
    """One row: of the true neighbours of all queries, the share that the approximate index finds."""
    v = load(spark, sf_dir, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    found = DenseIndex.build(v).search(asked, 20, skip_self=True).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    true = dense_top_k(v, asked, 20, skip_self=True).select("query_id", "chunk_id").join(found, ["query_id", "chunk_id"], "left")
    return true.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


@query
def embedder_gold_ranks(spark, sf_dir):
    """Items asked of the documents' vectors, by the learned embedder and by as many components of hashed trigrams: hits of a document that contains the item."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    golds, out = evaluation.containment_pairs(docs, items), None
    for name, embed in {"learned": fit_embedder(docs), "trigrams": partial(hashed_embedder, dim=DIM)}.items():
        vectors, asked = embedded(docs, embed=embed), embedded(items, embed=embed)
        found = dense_top_k(vectors, asked, 10, id_col="chunk_id", vector_col="v", query_id="query_id", query_vector="v")
        ranks = evaluation.gold_ranks(found, golds).select(F.lit(name).alias("embedder"), "query_id", "gold_rank")
        hits = evaluation.retrieval_metrics(ranks, ["embedder"])
        out = hits if out is None else out.union(hits)
    return rounded(out, "hit_at_1", "hit_at_3", "hit_at_10", "mrr", "ndcg_at_10")


def _hybrid(spark, sf_dir, **changes):
    chunks, vectors, asked = shared(spark, sf_dir)
    found = retrieve(chunks, asked, mode="hybrid", vectors=vectors, settings=replace(DEFAULTS, final_k=20, **changes))
    return rounded(found.select("query_id", "chunk_id", "dense_score", "bm25_score", "rrf_score", "rank"), "dense_score", "bm25_score", "rrf_score")


@query
def hybrid_rrf_k60(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query
def hybrid_rrf_k20(spark, sf_dir):
    return _hybrid(spark, sf_dir, rrf_k=20)


@query
def hybrid_rrf_k100(spark, sf_dir):
    return _hybrid(spark, sf_dir, rrf_k=100)


@query
def hybrid_weighted_70_30(spark, sf_dir):
    return _hybrid(spark, sf_dir, dense_weight=0.7, sparse_weight=0.3)


@query
def hybrid_weighted_30_70(spark, sf_dir):
    return _hybrid(spark, sf_dir, dense_weight=0.3, sparse_weight=0.7)


@query
def retrieve_final_k(spark, sf_dir):
    chunks, vectors, asked = shared(spark, sf_dir)
    items = retrieve(chunks, asked, mode="hybrid", vectors=vectors)
    return rounded(items.withColumn("text_md5", F.md5("text")).drop("text"), "dense_score", "rerank_score", "bm25_score", "rrf_score")


def _ranks(spark, sf_dir):
    chunks, vectors, asked = shared(spark, sf_dir)
    found = sweep(chunks, asked, BENCHMARK, vectors).where("query_id = chunk_id").groupBy("configuration", "query_id").agg(F.min("rank").alias("gold_rank"))
    grid = spark.createDataFrame([(c,) for c in BENCHMARK], "configuration string")
    return asked.select("query_id").crossJoin(F.broadcast(grid)).join(found, ["configuration", "query_id"], "left")


@query
def gold_rank_by_config(spark, sf_dir):
    return _ranks(spark, sf_dir)


@query
def retrieval_metrics_by_config(spark, sf_dir):
    return rounded(evaluation.retrieval_metrics(_ranks(spark, sf_dir), ["configuration"]), "hit_at_1", "hit_at_3", "hit_at_10", "mrr", "ndcg_at_10")


@query
def gold_containment(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    return evaluation.containment_pairs(docs, load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query
def gold_rank(spark, sf_dir):
    docs, asked = documents(spark, sf_dir), questions(spark, sf_dir)
    golds = evaluation.containment_pairs(docs.select(F.col("doc_id").alias("chunk_id"), "text"), asked.withColumnRenamed("query", "text"))
    return evaluation.gold_ranks(bm25_top_k(docs, asked, 10), golds)


@query
def dataset_self_check(spark, sf_dir):
    """Items without any document that contains them."""
    asked = questions(spark, sf_dir)
    golds = evaluation.containment_pairs(documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"), asked.withColumnRenamed("query", "text"))
    return asked.join(golds, "query_id", "left_anti").select("query_id")


@query
def gold_closure_sample(spark, sf_dir):
    """All gold documents, filled up to 500 by a seeded order."""
    docs = documents(spark, sf_dir)
    golds = evaluation.containment_pairs(docs.select(F.col("doc_id").alias("chunk_id"), "text"), questions(spark, sf_dir).withColumnRenamed("query", "text")).select(F.col("chunk_id").alias("doc_id")).distinct()
    keyed = docs.select("doc_id").join(golds.withColumn("gold", F.lit(True)), "doc_id", "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    return keyed.orderBy(F.desc("gold"), F.md5(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string"))), "doc_id").limit(500)


# --- re-ranking -----------------------------------------------------------------


def _candidates(spark, sf_dir):
    """Chunks, questions, and the hybrid pools of 20 with their texts, which no window has carried."""
    chunks, vectors, asked = shared(spark, sf_dir)
    items = written(retrieve(chunks, asked, mode="hybrid", vectors=vectors, settings=replace(DEFAULTS, final_k=20)).drop("text", "rerank_score"), "items")
    return chunks, asked, alone(items).join(chunks.select("chunk_id", "text"), "chunk_id").join(asked.select("query_id", "query"), "query_id")


def _pool(spark, sf_dir):
    """Hybrid pools of 20 with the re-ranker's score, and the re-ranked order; without texts."""
    return written(rerank(_candidates(spark, sf_dir)[2], 20, lexical_overlap).drop("text", "query"), "pool")


@query
def rerank_topk(spark, sf_dir):
    return rounded(_pool(spark, sf_dir).where("final_rank <= 3").select("query_id", "chunk_id", "rerank_score", "final_rank"), "rerank_score", digits=4)


@query
def rerank_depth_sweep(spark, sf_dir):
    depths = spark.createDataFrame([(d,) for d in (3, 5, 10, 20)], "depth int")
    moved = partial_rerank(_pool(spark, sf_dir).crossJoin(F.broadcast(depths)), F.col("depth"))
    ranks = moved.groupBy("depth", "query_id").agg(F.min(F.when(F.col("chunk_id") == F.col("query_id"), F.col("new_rank"))).alias("gold_rank"))
    return rounded(evaluation.retrieval_metrics(ranks, ["depth"]).select("depth", "hit_at_1", "hit_at_3", "mrr"), "hit_at_1", "hit_at_3", "mrr")


@query
def blend_alpha_sweep(spark, sf_dir):
    grid = spark.createDataFrame([(i / 10,) for i in range(11)], "alpha double")
    mixed = blended(_pool(spark, sf_dir).crossJoin(F.broadcast(grid)), F.col("alpha"))
    ranks = mixed.groupBy("alpha", "query_id").agg(F.min(F.when(F.col("chunk_id") == F.col("query_id"), F.col("new_rank"))).alias("gold_rank"))
    return rounded(evaluation.retrieval_metrics(ranks, ["alpha"]).select("alpha", "hit_at_1", "hit_at_3", "mrr"), "hit_at_1", "hit_at_3", "mrr")


@query
def demotion_analysis(spark, sf_dir):
    gold = F.col("chunk_id") == F.col("query_id")
    ranks = _pool(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(gold, F.col("rank"))).alias("pre_rank"), F.min(F.when(gold, F.col("final_rank"))).alias("post_rank"))
    return evaluation.demotions(ranks)


@query
def rerank_comparison(spark, sf_dir):
    """Both re-rankers over the same pools: hits of the gold document, and how often each moved it from or to the first place."""
    chunks, asked, pool = _candidates(spark, sf_dir)
    weights = term_weights(chunks.select("text"), asked.select("query_id", "query"))
    both = {"lexical": rerank(pool, 20, lexical_overlap), "interaction": rerank_by_interaction(pool, weights, 20)}
    both = {name: written(ordered.drop("text", "query"), name) for name, ordered in both.items()}
    out, gold = None, F.col("chunk_id") == F.col("query_id")
    for name, ordered in both.items():
        ranks = ordered.groupBy("query_id").agg(F.min(F.when(gold, F.col("rank"))).alias("pre_rank"), F.min(F.when(gold, F.col("final_rank"))).alias("post_rank"))
        hits = evaluation.retrieval_metrics(ranks.select(F.lit(name).alias("scorer"), "query_id", F.col("post_rank").alias("gold_rank")), ["scorer"]).select("scorer", "hit_at_1", "hit_at_3", "mrr")
        own = hits.crossJoin(F.broadcast(evaluation.demotions(ranks)))  # one row each
        out = own if out is None else out.union(own)
    return rounded(out, "hit_at_1", "hit_at_3", "mrr")


@query
def demotion_causes(spark, sf_dir):
    pool, texts = _pool(spark, sf_dir), documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    gold = pool.where("chunk_id = query_id and rank = 1 and final_rank > 1").join(texts, "chunk_id").select("query_id", F.col("source").alias("gold_title"), F.col("text").alias("gold_text"))
    preferred = pool.where("final_rank = 1").join(texts, "chunk_id").select("query_id", F.col("source").alias("preferred_title"), F.col("text").alias("preferred_text"))
    return evaluation.demotion_causes(gold.join(preferred, "query_id"))


@query
def token_length_stats(spark, sf_dir):
    n = text.count_tokens(F.col("text"))
    return rounded(documents(spark, sf_dir).select(n.alias("n")).agg(F.avg("n").alias("avg_tokens"), F.max("n").alias("max_tokens"), F.sum((F.col("n") > 512).cast("long")).alias("over_512"), F.percentile("n", 0.95).alias("p95_tokens")), "avg_tokens", "p95_tokens")


# --- text functions ---------------------------------------------------------------


@query
def tokenize_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.tokenize(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query
def sentence_split(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("idx", "sentence"))


@query
def replay_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.replay_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_pieces"), F.md5(F.array_join("t", "")).alias("joined_md5"))


@query
def text_normalisers(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.md5(text.clean_lines(t)).alias("clean_lines"), F.md5(text.normalize_match(t)).alias("for_match"), F.md5(text.normalize_match(t, lower=False)).alias("collapsed"), F.md5(text.normalize_dedup(t)).alias("for_dedup"), F.md5(text.normalize_answer(t)).alias("as_answer"), text.count_tokens(t).alias("n_tokens"))


@query
def factual_tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.factual_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join(F.sort_array("t"), " ")).alias("tokens_md5"))


def _lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))


def _headed(spark, sf_dir):
    """Lines of the documents, and before each the headings that it would have: marked, numbered, in capitals, and lines that are nearly so."""
    first = F.col("first")  # a column of its own, as the array names it five times
    heads = F.array(F.concat(F.lit("## "), first), F.concat((F.col("idx") + 1).cast("string"), F.lit(". "), F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 30)), F.upper(first), F.concat(F.lit("1.2 "), F.lower(first)), F.concat(F.lit("#"), first), "line")
    lines = _lines(spark, sf_dir).withColumn("first", F.substring(F.regexp_replace("line", "[^A-Za-z ]+", ""), 1, 30))
    return lines.select("doc_id", "idx", F.posexplode(heads).alias("kind", "line")).select("doc_id", (F.col("idx") * 6 + F.col("kind")).alias("idx"), "line")


@query
def heading_lines(spark, sf_dir):
    return _headed(spark, sf_dir).where(text.is_heading(F.col("line"))).select("doc_id", "idx", "line")


@query
def table_lines(spark, sf_dir):
    return _lines(spark, sf_dir).where(text.is_table_line(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n_table_lines"))


@query
def heading_sections(spark, sf_dir):
    lines = _headed(spark, sf_dir).withColumn("line", text.strip_ws(F.col("line"))).where("line <> ''")
    order = Window.partitionBy("doc_id").orderBy("idx")
    numbered = lines.withColumn("section", F.sum(text.is_heading(F.col("line")).cast("int")).over(order))
    return numbered.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query
def page_split(spark, sf_dir):
    return read_text_table(load(spark, sf_dir, "documents")).select("doc_id", "page", F.md5("text").alias("text_md5"))


@query
def table_row_serialisation(spark, sf_dir):
    """Event properties as ``Header: cell`` rows."""
    row = text.table_row(F.array(F.lit("event"), F.lit(""), F.lit("user")), F.array("event_type", F.col("value").cast("bigint").cast("string"), F.col("user_id").cast("string")))
    return load(spark, sf_dir, "events").select("event_id", row.alias("row"))


@query
def scalar_functions(spark, sf_dir):
    v = F.col("value")
    rank = (F.col("event_id") % 15 + 1).cast("int")
    return rounded(load(spark, sf_dir, "events").select("event_id", text.sigmoid(v).alias("sigmoid"), evaluation.gain(rank).alias("gain"), evaluation.reciprocal(rank).alias("reciprocal"), text.safe_ratio(v, rank - 1).alias("ratio"), text.finish_reason(rank, F.lit(8)).alias("finish"), text.client_ip(F.concat(F.lit(" 10.0.0."), rank.cast("string"), F.lit(" , 10.1.1.1"))).alias("ip"), text.sse_payload(F.concat(F.lit("data: "), F.col("props"))).alias("payload")), "sigmoid", "gain", "reciprocal", "ratio")


# --- redaction ----------------------------------------------------------------------


def _entities():
    return F.array(*(F.lit(e) for e, _ in pii.recognizers()))


@query
def pii_redact_documents(spark, sf_dir):
    clean = documents(spark, sf_dir).select("doc_id", pii.redaction(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.md5("clean.text").alias("text_md5"), pii.redaction_count(F.col("clean.counts")).alias("redactions"))


@query
def pii_counts_by_entity(spark, sf_dir):
    clean = documents(spark, sf_dir).select(pii.redaction(F.col("text"))["counts"].alias("counts"))
    counts = clean.select(F.explode(F.transform("counts", lambda n, i: F.struct(F.get(_entities(), i).alias("entity"), n.cast("long").alias("n")))).alias("x"))
    return counts.groupBy("x.entity").agg(F.sum("x.n").alias("redactions"), F.sum((F.col("x.n") > 0).cast("long")).alias("documents"))


@query
def pii_eval_scores(spark, sf_dir):
    """Documents as cases: without an entity a false-positive case, with one kind a recall case, else a multi-entity case."""
    clean = documents(spark, sf_dir).select("text", pii.redaction(F.col("text")).alias("clean"))
    kinds = F.filter(F.transform("clean.counts", lambda n, i: F.when(n > 0, F.get(_entities(), i))), lambda x: x.isNotNull())
    cases = clean.select("text", kinds.alias("kinds"), F.col("clean.text").alias("redacted"), pii.redaction_count(F.col("clean.counts")).alias("redactions"))
    one = F.when(F.size("kinds") == 1, F.get("kinds", 0))
    cases = cases.withColumns({"category": F.when(F.size("kinds") == 0, "false_positive").when(F.size("kinds") == 1, "recall").otherwise("multi_entity"), "expected_entity": one, "expected_placeholder": F.concat(F.lit("<"), one, F.lit(">"))})
    return rounded(evaluation.pii_scores(cases), "rate")


# --- the chunk table -------------------------------------------------------------------


def _chunks(spark, sf_dir):
    """Lines as structure chunks and sentences as semantic chunks; no character chunks."""
    docs = documents(spark, sf_dir)
    parts = lambda name, pieces: docs.select("doc_id", "source", F.lit(name).alias("strategy"), F.lit(1).alias("page"), F.posexplode(pieces).alias("chunk_idx", "text"))
    return parts("structure", F.split("text", "\n")).union(parts("semantic", text.sentences(F.col("text"))))


@query
def dedup_content_hash(spark, sf_dir):
    return store.first_of_each_content(store.with_hash(documents(spark, sf_dir)))


@query
def dedup_new_documents(spark, sf_dir):
    """Documents of other sources whose content src0 does not hold."""
    docs = store.with_hash(documents(spark, sf_dir))
    return store.new_documents(docs.where("source <> 'src0'"), docs.where("source = 'src0'")).select("doc_id")


@query
def dedup_refused_documents(spark, sf_dir):
    docs = store.with_hash(documents(spark, sf_dir))
    return store.duplicates(docs.where("source <> 'src0'"), docs.where("source = 'src0'")).select("doc_id", "existing_id")


@query
def document_inventory(spark, sf_dir):
    return store.inventory(_chunks(spark, sf_dir))


@query
def chunk_counts_by_strategy(spark, sf_dir):
    return store.counts_by_strategy(_chunks(spark, sf_dir))


@query
def length_stats_by_strategy(spark, sf_dir):
    return rounded(store.length_stats(_chunks(spark, sf_dir)), "avg_len")


@query
def upsert_chunks(spark, sf_dir):
    """French documents come again in capitals."""
    old = _chunks(spark, sf_dir)
    new = old.join(documents(spark, sf_dir).where("lang = 'fr'").select("doc_id"), "doc_id", "left_semi").withColumn("text", text.capitals(F.col("text"))).select(*old.columns)
    return store.upsert(old, new).select("doc_id", "strategy", "page", "chunk_idx", F.md5("text").alias("text_md5"))


@query
def delete_document(spark, sf_dir):
    return store.inventory(store.without_document(_chunks(spark, sf_dir), 7)).select("doc_id", "total_chunks")


def _chunker(spark, sf_dir, strategy):
    pages = documents(spark, sf_dir).select("doc_id", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("source"), F.lit(1).alias("page"), "text")
    return chunk_pages(pages, [strategy])


@query
def chunk_character(spark, sf_dir):
    return _chunker(spark, sf_dir, "character")


@query
def chunk_structure(spark, sf_dir):
    return _chunker(spark, sf_dir, "structure")


@query
def chunk_semantic(spark, sf_dir):
    return _chunker(spark, sf_dir, "semantic")


# --- routing and classification ------------------------------------------------------------


def _router(spark, sf_dir):
    """The first vectors of every label are its exemplars, kept task by task; all others ask."""
    vectors = load(spark, sf_dir, "embeddings")
    first = vectors.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where(F.col("n") <= EXEMPLARS)
    bank = first.select(F.col("vec_id").alias("exemplar_id"), F.col("label").cast("string").alias("intent"), F.col("embedding").alias("v"))
    asked = vectors.join(F.broadcast(first.select("vec_id")), "vec_id", "left_anti").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("actual"), F.col("embedding").alias("v"))
    return router.intent_scores(asked, bank), asked.drop("v")


@query
def router_topk_mean(spark, sf_dir):
    return rounded(_router(spark, sf_dir)[0], "score")


def _routed(spark, sf_dir, threshold=DEFAULTS.router_threshold):
    scores, asked = _router(spark, sf_dir)
    return router.route(scores, INTENTS, threshold=threshold).join(asked, "query_id")


@query
def router_route(spark, sf_dir):
    return rounded(_routed(spark, sf_dir).drop("actual"), "confidence")


@query
def router_threshold_sweep(spark, sf_dir):
    best = _routed(spark, sf_dir, -1.0).withColumnRenamed("intent", "best")
    grid = [round(0.05 * i, 2) for i in range(6, 17)]
    return rounded(router.threshold_sweep(best, grid), "accuracy")


@query
def router_confusion(spark, sf_dir):
    pairs = _routed(spark, sf_dir, -1.0).select("actual", F.col("intent").alias("predicted"))
    return router.confusion(pairs, INTENTS)


@query
def router_prf(spark, sf_dir):
    pairs = _routed(spark, sf_dir, -1.0).select("actual", F.col("intent").alias("predicted"))
    return rounded(router.class_metrics(pairs), "precision", "recall", "f1")


@query
def leakage_semi_join(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return router.leaked(docs.where("source <> 'src0'"), docs.where("source = 'src0'")).select("doc_id")


@query
def adjacent_similarity(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return rounded(router.adjacent_similarity(rows, ["label"], "vec_id").select("vec_id", "label", "similarity"), "similarity")


# --- answers -----------------------------------------------------------------------------------


@query
def token_budget_pack(spark, sf_dir):
    items = top_documents(spark, sf_dir, 5)
    scaffold = F.concat(F.lit("\nQuestion: "), F.col("query"), F.lit("\n\nContext:\n\n\nAnswer:"))
    return answers.budgeted(items, budget=DEFAULTS.token_budget, scaffold=scaffold, trim=False).select("query_id", "chunk_id", "rank", "cost", "used")


@query
def context_prompts(spark, sf_dir):
    items = top_documents(spark, sf_dir, 5)
    scaffold = F.concat(F.lit("\nQuestion: "), F.col("query"), F.lit("\n\nContext:\n\n\nAnswer:"))
    made = answers.prompts(answers.budgeted(items, budget=DEFAULTS.token_budget, scaffold=scaffold, trim=False))
    return made.select("query_id", F.md5("context").alias("context_md5"), F.md5("prompt").alias("prompt_md5"))


def _answers(spark, sf_dir):
    """(query_id, query, answer, chunks): stub answers with the three best documents."""
    items = top_documents(spark, sf_dir, 3)
    asked = questions(spark, sf_dir)
    chunks = items.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("chunks"))
    return asked.join(answers.stub_answers(items, asked), "query_id").join(chunks, "query_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))


@query
def answer_stub(spark, sf_dir):
    return _answers(spark, sf_dir).select("query_id", "answer", text.is_refusal(F.col("answer")).alias("refused"), text.is_full_refusal(F.col("answer")).alias("refused_fully"))


@query
def answer_em_f1(spark, sf_dir):
    golds = F.array("query", F.get("chunks", 0))
    a = _answers(spark, sf_dir)
    return rounded(a.select("query_id", *(c.alias(n) for n, c in answers.exact_match(F.col("answer"), F.array("query")).items()), answers.token_f1(F.col("answer"), F.array("query")).alias("f1"), answers.token_f1(F.col("answer"), golds).alias("f1_two_golds")), "f1", "f1_two_golds")


@query
def citation_validity(spark, sf_dir):
    found = answers.citation_validity(F.concat(F.col("answer"), F.lit(" [7] [1, 2]")), F.size("chunks"))
    return rounded(_answers(spark, sf_dir).select("query_id", *(c.alias(n) for n, c in found.items())), "validity")


@query
def grounding_ratio(spark, sf_dir):
    """The question as an answer: how much of it the documents have."""
    cited = answers.cited_grounding(F.concat(F.col("query"), F.lit(" [1] [9]")), F.col("chunks"))
    return rounded(_answers(spark, sf_dir).select("query_id", answers.grounding(F.col("query"), F.col("chunks")).alias("grounding"), cited["grounding"].alias("cited_grounding"), F.array_join(cited["ungrounded"], " ").alias("ungrounded")), "grounding")


@query
def answer_quality(spark, sf_dir):
    a = _answers(spark, sf_dir)
    v = answers.citation_validity(F.col("answer"), F.size("chunks"))
    scored = a.select(v["has_citation"].alias("cited"), v["validity"].alias("validity"), answers.grounding(F.col("answer"), F.col("chunks")).alias("grounding"), text.is_refusal(F.col("answer")).alias("refused"), answers.exact_match(F.col("answer"), F.array("query"))["em_contains"].alias("em"), answers.token_f1(F.col("answer"), F.array("query")).alias("f1"))
    out = scored.agg(F.count("*").alias("answers"), F.avg(F.col("cited").cast("double")).alias("citation_presence"), F.avg(F.when(F.col("cited"), F.col("validity"))).alias("citation_precision"), F.avg("grounding").alias("grounding"), F.avg(F.col("refused").cast("double")).alias("refusal_rate"), F.avg((F.col("grounding") < 1).cast("double")).alias("hallucination_rate"), (F.avg("em") * 100).alias("em_percent"), (F.avg("f1") * 100).alias("f1_percent"))
    return rounded(out, *[c for c in out.columns if c != "answers"])


@query
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap_ci(_answers(spark, sf_dir).select("query_id", answers.token_f1(F.col("answer"), F.array("query")).alias("f1")), "f1", "query_id")


# --- conversations and requests --------------------------------------------------------------------


@query
def conversation_limits(spark, sf_dir):
    return conversations.check_limits(load(spark, sf_dir, "conversations"), replace(DEFAULTS, max_messages=4, max_message_chars=400))


@query
def conversation_redact(spark, sf_dir):
    return conversations.redact_turns(load(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), "redactions")


@query
def conversation_trim(spark, sf_dir):
    return conversations.trim_to_context(load(spark, sf_dir, "conversations"), window=400, max_tokens=100).select("conv_id", "turn", "role", "tokens", "fits")


@query
def last_user_turn(spark, sf_dir):
    return conversations.last_user_turn(load(spark, sf_dir, "conversations"))


TOTALS = ("pii_redactions", "prompt_tokens", "completion_tokens")


def _requests(spark, sf_dir):
    """Events as chat requests: a status, redactions and tokens from the event's number and properties."""
    n = F.col("event_id")
    code = F.when(n % 20 == 0, 429).when(n % 20 == 1, 400).otherwise(200)
    return load(spark, sf_dir, "events").withColumns({"code": code, "pii_redactions": n % 3, "prompt_tokens": F.length("props").cast("long"), "completion_tokens": n % 50})


@query
def request_metrics(spark, sf_dir):
    return rounded(request_counters(_requests(spark, sf_dir), status="code", sums=TOTALS), "duration_sum", digits=3)


@query
def requests_in_flight_by_minute(spark, sf_dir):
    """Events as requests that take as many seconds as their value says."""
    return requests_in_flight(load(spark, sf_dir, "events")).withColumn("unit_start", F.date_format("unit_start", "yyyy-MM-dd HH:mm:ss"))


@query
def request_windows(spark, sf_dir):
    return windowed_counters(load(spark, sf_dir, "events")).select(F.col("start").cast("string").alias("start"), "intent", "requests")


@query
def request_exposition(spark, sf_dir):
    counters = request_counters(_requests(spark, sf_dir).withColumn("seconds", F.lit(0.25)), status="code", value="seconds", sums=TOTALS)
    return exposition(counters.withColumnRenamed("requests", "n"), request_totals(counters))


@query
def rate_limit_attempts_window(spark, sf_dir):
    """Attempts of the same user in the 60 seconds before; counts denied ones, too."""
    t = F.col("ts").cast("timestamp").cast("double")
    own = Window.partitionBy("user_id").orderBy("t").rangeBetween(-60, 0)
    return load(spark, sf_dir, "events").withColumn("t", t).select("event_id", F.count("*").over(own).alias("attempts"))


@query
def rate_limit_decisions(spark, sf_dir):
    return rate_limit(load(spark, sf_dir, "events"), limit=2, window=3600)


# --- answers and requests as services give them --------------------------------------------------------


def _plain_chunks(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text", "source", F.lit(1).alias("page"))


@query
def query_responses(spark, sf_dir):
    """Every benchmark item as a question, those of over 200 characters refused with the reason."""
    found = respond(_plain_chunks(spark, sf_dir), questions(spark, sf_dir), mode="sparse", settings=replace(DEFAULTS, max_query_chars=200))
    return found.select("query_id", "status", "detail", "total_retrieved", F.array_join(F.transform("results", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"))


@query
def answer_sources(spark, sf_dir):
    """Answers by a generator that repeats the question, with their sources and tokens."""
    found = answer(_plain_chunks(spark, sf_dir), questions(spark, sf_dir), mode="sparse", settings=replace(DEFAULTS, token_budget=10_000_000), generator=lambda q, p: F.concat(F.lit("You ask: "), q))
    return found.select("query_id", "answer", "n_sources", F.array_join(F.transform("sources", lambda x: F.concat_ws("/", x["chunk_id"].cast("string"), x["source"], x["page"].cast("string"))), ",").alias("sources"), "prompt_tokens", "completion_tokens")


@query
def unanswerable_refusals(spark, sf_dir):
    """Questions whose every word is unknown to the documents are refused."""
    asked = spark.createDataFrame([(i, "".join(f"zq{w} " for w in q.split())) for i, q in enumerate(UNANSWERABLE)], "query_id long, query string")
    found = answer(_plain_chunks(spark, sf_dir), asked, mode="sparse")
    return found.agg(F.count("*").alias("cases"), F.avg(text.is_full_refusal(F.col("answer")).cast("double") * 100).alias("refusal_accuracy"))


def _cases(spark):
    rows = [(i, c, x, a, c == "refusal") for i, c, x, a in ANSWER_CASES]
    return spark.createDataFrame(rows, "id string, category string, contexts array<string>, answer string, expected_refusal boolean")


@query
def faithfulness_cases(spark, sf_dir):
    return evaluation.faithfulness(_cases(spark))


@query
def faithfulness_by_kind(spark, sf_dir):
    marked = evaluation.faithfulness(_cases(spark))
    return evaluation.faithfulness_summary(marked, ["category"]).union(evaluation.faithfulness_summary(marked).select(F.lit("all").alias("category"), "*"))


def _document_cases(spark, sf_dir):
    """Cases of every benchmark item: its own lead sentence, that of a document it does not cite, and a refusal.

    The contexts are the item and the document with the item's number, the foreign answer is of the next document.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").alias("doc_text"))
    items = load(spark, sf_dir, "benchmark").join(docs.withColumnRenamed("doc_id", "item_id"), "item_id", "left")
    foreign = docs.select((F.col("doc_id") - 1).alias("item_id"), F.col("doc_text").alias("foreign"))
    kinds = {"grounded": text.lead_answer(F.col("text")), "hallucination": text.lead_answer(F.col("foreign")), "refusal": F.lit(REFUSAL)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), a.alias("answer")) for k, a in kinds.items()]))
    cases = items.join(foreign, "item_id", "left").select("item_id", F.filter(F.array("text", "doc_text"), F.isnotnull).alias("contexts"), each.alias("x"))
    return cases.select(F.concat_ws("-", "item_id", "x.category").alias("id"), "x.category", "contexts", "x.answer", (F.col("x.category") == "refusal").alias("expected_refusal"))


@query
def faithfulness_documents(spark, sf_dir):
    return evaluation.faithfulness(_document_cases(spark, sf_dir))


@query
def faithfulness_documents_by_kind(spark, sf_dir):
    marked = evaluation.faithfulness(_document_cases(spark, sf_dir))
    return evaluation.faithfulness_summary(marked, ["category"]).union(evaluation.faithfulness_summary(marked).select(F.lit("all").alias("category"), "*"))


@query
def chat_counters(spark, sf_dir):
    """All conversations through the chat path over all documents, counted as requests: (intent, route, status, requests, redactions, tokens, answered).

    Exemplars are the first lines of the first documents, which ask for documents, and the first things that assistants said.
    """
    docs, turns = _plain_chunks(spark, sf_dir), load(spark, sf_dir, "conversations")
    line = lambda c: F.substring(F.get(F.split(c, "\n"), 0), 1, 200)
    rag = docs.orderBy("chunk_id").limit(EXEMPLARS).select(F.col("chunk_id").alias("exemplar_id"), F.lit("rag").alias("intent"), line("text").alias("text"))
    general = turns.where("role = 'assistant'").orderBy("conv_id", "turn").limit(EXEMPLARS).select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("exemplar_id"), F.lit("general").alias("intent"), line("text").alias("text"))
    vectors = written(embedded(docs.select("chunk_id", "text")).select("chunk_id", "v"), "vectors")
    found = chat(turns, embedded(rag.unionByName(general)), docs, intents=["general", "rag"], vectors=vectors)
    return found.groupBy("intent", "route", "status").agg(F.count("*").alias("requests"), F.sum("redactions").alias("redactions"), F.sum("tokens").alias("tokens"), F.count("answer").alias("answered"))


@query
def refusals_by_threshold(spark, sf_dir):
    """The last thing that each user says, asked of the documents: refused where no retrieved text has 60 % of its words."""
    asked = conversations.last_user_turn(load(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    found = answer(_plain_chunks(spark, sf_dir), asked, mode="sparse", scorer=lexical_overlap, threshold=0.6)
    return found.where("status = 200").select("query_id", text.is_full_refusal(F.col("answer")).alias("refused"))


@query
def downgrade_reasons(spark, sf_dir):
    n = F.col("event_id")
    error = F.when(n % 11 == 0, "offline").when(n % 11 == 1, "timeout").when(n % 11 == 2, "ValueError")
    status = F.when(n % 5 == 0, 503).when(n % 5 == 1, 404).otherwise(200)
    return load(spark, sf_dir, "events").select("event_id", text.downgrade_reason(status, n % 4, error).alias("reason"), text.api_url(F.concat(F.lit("http://host/"), F.when(n % 2 == 0, "v1/").otherwise("x//")), "/chat/completions").alias("url"))


@query
def latency_by_type(spark, sf_dir):
    return rounded(evaluation.latency(load(spark, sf_dir, "events"), "event_type", "value"), "mean_ms", "p95_ms")


@query
def hits_by_category(spark, sf_dir):
    """Hit@1 of short and long questions under BM25."""
    ranks = gold_rank(spark, sf_dir).join(questions(spark, sf_dir), "query_id")
    ranks = ranks.withColumns({"category": F.when(F.length("query") > 200, "long").otherwise("short"), "configuration": F.lit("bm25")})
    found = evaluation.hits_by_category(ranks, ["short", "long"], ["configuration"])
    return rounded(found, "short_hit_at_1", "long_hit_at_1", "mrr_at_3")


@query
def router_best_threshold(spark, sf_dir):
    best = _routed(spark, sf_dir, -1.0).withColumnRenamed("intent", "best")
    return rounded(router.best_threshold(router.threshold_sweep(best, [round(0.05 * i, 2) for i in range(6, 17)])), "accuracy")


@query
def routing_results(spark, sf_dir):
    return router.routing_result(_routed(spark, sf_dir).drop("actual"))


@query
def two_way_containment(spark, sf_dir):
    """Lines of documents against the first line of the document before, either within the other."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.get(F.split("text", "\n"), 0).alias("line"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.substring("line", 1, 12).alias("expected"))
    found = evaluation.contained(F.col("line"), F.col("expected"), both_ways=True)
    return docs.join(before, "doc_id").select("doc_id", F.coalesce(found, F.lit(False)).alias("contained"))


@query
def chunk_table_function(spark, sf_dir):
    """Chunks by the table function in SQL, counted."""
    register_chunkers(spark)
    documents(spark, sf_dir).createOrReplaceTempView("tessera_documents")
    return spark.sql("select strategy, count(*) as chunks, sum(length(chunk)) as chars from tessera_documents, values ('character'), ('structure'), ('semantic') as s(strategy), lateral chunk_text(text, strategy) group by strategy")
