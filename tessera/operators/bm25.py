"""BM25 over chunks for a table of queries.

Statistics of the collection (number of chunks, average length) come from all
chunks, blank ones included. ``bm25_top_k`` reads the chunks twice, first for the
statistics of the queries' terms, then to score them where they are: each task keeps
the k best of every query, so that no more than tasks x queries x k rows are shuffled.
Queries of the same terms are asked once. Many queries are first asked of a sixteenth of the chunks: what their k-th best reaches there is the
least that a chunk must reach anywhere, so that few chunks are scored in double precision or leave a task.
``bm25_scores`` gives the scores of all pairs that share a term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.functions.text import tokenize
from tessera.operators.posting_blocks import Questions, identifiers
from tessera.operators.term_sums import Sums
from tessera.shared import written

#: Distinct query terms, and terms of all queries, that are broadcast at most.
BROADCAST_TERMS = 500_000
#: Terms of queries, each query's counted for itself, that are handed to every task at once.
TERMS_AT_ONCE = 3_000_000
#: From how many queries on a part of the chunks, one in ``PILOT_PART``, is scored first.
PILOT_QUERIES = 500
PILOT_PART = 16
_ASCII_WORD = np.array([chr(c).isalnum() or chr(c) == "_" if c < 128 else False for c in range(256)])
#: Of each code point, whether it belongs to a word; -1 until it is met.
_KNOWN = np.full(0x110000, -1, np.int8)


def tokenized(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tokens = tokenize(F.coalesce(F.col(text_col), F.lit("")))
    return chunks.select(F.col(id_col).alias("chunk_id"), tokens.alias("tokens")).withColumn("dl", F.size("tokens"))


def exploded(rows: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """One row a term. The outer form keeps the optimiser from tokenising once more to find empty rows."""
    return rows.select(*keep, F.explode_outer(tokens).alias("term")).where(F.col("term").isNotNull())


def corpus_stats(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: n_chunks, total_tokens and avgdl (1 for an empty collection's length)."""
    return tokenized(chunks, id_col, text_col).agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, chunk_id, tf, dl) of every term."""
    return exploded(tokenized(chunks, id_col, text_col), F.col("tokens"), "chunk_id", "dl").groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def idf(df, n):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_stats(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, cf, idf) of every term."""
    n = tokenized(chunks, id_col, text_col).agg(F.count("*").alias("n_chunks"))
    counts = postings(chunks, id_col, text_col).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return counts.crossJoin(F.broadcast(n)).select("term", "df", "cf", idf(F.col("df"), F.col("n_chunks")).alias("idf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query_id, term, qtf): terms with their multiplicity."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", allowed: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs that share a term.

    ``allowed`` (chunk_id) restricts what is scored; statistics stay those of all chunks.
    """
    asked = query_terms(queries, query_id, query_text)
    small = lambda df: F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df
    terms = small(asked.select("term").distinct().union(asked.sparkSession.createDataFrame([("",)], "term string")))
    rows = tokenized(chunks, id_col, text_col)
    # one pass over the texts: terms of queries, and the empty term, which stands for the chunk itself
    marked = exploded(rows, F.array_append("tokens", ""), "chunk_id", "dl").join(terms, "term", "left_semi")
    held = marked.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    counts = held.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))
    whole = counts.where("term = ''").select(F.col("df").alias("n_chunks"), (F.col("total") / F.col("df")).alias("avgdl"))  # one row
    weights = asked.join(counts, "term").crossJoin(F.broadcast(whole)).select("query_id", "term", "avgdl", (F.col("qtf") * idf(F.col("df"), F.col("n_chunks"))).alias("weight"))
    weights = F.broadcast(weights) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else weights
    scored = held.where("term <> ''")
    scored = scored if allowed is None else scored.join(allowed, "chunk_id", "left_semi")
    length = 1 - settings.b + settings.b * F.col("dl") / F.col("avgdl")
    gain = F.col("weight") * F.col("tf") * (settings.k1 + 1) / (F.col("tf") + settings.k1 * length)
    return scored.join(weights, "term").groupBy("query_id", "chunk_id").agg(F.sum(gain).alias("score"))


def lowered(rows: DataFrame, id_col: str, text_col: str, name: str = "chunk_id") -> DataFrame:
    """(id, text): what ``split_tokens`` cuts in a task, many times faster than a column expression."""
    return rows.select(F.col(id_col).alias(name), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to a letter, a digit or the underscore."""
    word = _ASCII_WORD[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first, padded = data[lead].astype(np.int32), np.append(data, np.zeros(3, np.uint8))
        width = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> width)
        for at in (1, 2, 3):
            more = np.flatnonzero(at < width)
            code[more] = code[more] << 6 | padded[lead[more] + at] & 0x3F
        code = np.minimum(code, len(_KNOWN) - 1)
        new = np.unique(code[_KNOWN[code] < 0])
        if len(new):
            letters = pa.array([chr(c) if not 0xD800 <= c < 0xE000 else " " for c in new.tolist()], pa.string())
            _KNOWN[new] = pc.match_substring_regex(letters, pattern=r"[\p{L}\p{N}_]").to_numpy(zero_copy_only=False)
        lead, width = lead[_KNOWN[code] == 1], width[_KNOWN[code] == 1]
        word[lead] = True
        for at in (1, 2, 3):
            some = lead[at < width] + at
            word[some[some < len(word)]] = True
    return word


def split_tokens(texts: pa.Array) -> pa.ListArray:
    """``tokenize`` of lower-cased texts, none of them null; bytes are told apart by a table, since a pattern takes ten times as long."""
    texts = texts.cast(pa.string())
    _, places, content = texts.buffers()
    ends = np.zeros(1, np.int32) if places is None else np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.empty(0, np.uint8) if content is None else np.frombuffer(content, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = word_bytes(data)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(data)]  # no token goes on into the next text
    begins[first] = word[first]
    cuts = np.searchsorted(np.flatnonzero(begins), ends).astype(np.int32)
    starts = np.flatnonzero(begins[word])
    kept = data[word]
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(kept)).astype(np.int32)), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(pa.array(cuts), flat)


def split_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_terms`` by ``split_tokens``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), split_tokens(batch.column(1))], names=["query_id", "tokens"])

    rows = lowered(queries, id_col, text_col, "query_id")
    cut = rows.mapInArrow(split, f"query_id {rows.schema['query_id'].dataType.simpleString()}, tokens array<string>")
    return cut.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def question_blocks(queries: DataFrame, id_col: str, text_col: str, settings: Settings = DEFAULTS, split: Callable[[DataFrame, str, str], DataFrame] = query_terms) -> Iterator[tuple[Questions, pa.DataType]]:
    """The queries in blocks of a bounded number of terms, with the type of their ids; a query without words is in none."""
    yield from blocks_of(written(split(queries, id_col, text_col).where(F.col("query_id").isNotNull()), "query-terms"), settings)


def blocks_of(terms: DataFrame, settings: Settings = DEFAULTS) -> Iterator[tuple[Questions, pa.DataType]]:
    """``question_blocks`` of queries that are (query_id, term, qtf)."""
    blocks = max(1, -(-terms.count() // TERMS_AT_ONCE))
    for block in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if some.num_rows:
            coded = some["term"].combine_chunks().dictionary_encode()
            ids, query = np.unique(identifiers(some["query_id"]), return_inverse=True)
            order = np.argsort(query, kind="stable")
            start = np.searchsorted(query[order], np.arange(len(ids) + 1))
            yield Questions(ids, coded.dictionary.to_pylist(), start, coded.indices.to_numpy()[order], some["qtf"].to_numpy()[order], k1=settings.k1, b=settings.b), some["query_id"].type


def asked_once(queries: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, qtf) of one query of those that have the same terms as often, and (query_id, as_id): which one stands for each."""
    terms = written(split_terms(queries, id_col, text_col).where(F.col("query_id").isNotNull()), "query-terms")
    own = written(terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "qtf"))).alias("own")), "query-own")  # within a query's length
    first = own.groupBy("own").agg(F.min("query_id").alias("as_id"))
    alike = written(own.join(first, "own").select("query_id", "as_id"), "alike")
    return terms.join(alike.where("query_id = as_id"), "query_id", "left_semi"), alike


def arrow_name(kind: pa.DataType) -> str:
    return "string" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else "int" if kind == pa.int32() else "long"


def frequencies(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> tuple[np.ndarray, int, int]:
    """In how many of the batches' lower-cased texts each term is, and the number of texts and of their tokens."""
    df, chunks, total = np.zeros(len(terms), np.int64), 0, 0
    for batch in batches:
        tokens = split_tokens(batch.column(0))
        number = pc.index_in(tokens.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)[number >= 0]
        key = np.sort(number[number >= 0] * len(lengths) + row)  # np.unique without counts hashes, which takes twelve times as long
        df += np.bincount(key[np.diff(key, prepend=-1) > 0] // max(1, len(lengths)), minlength=len(terms))
        chunks, total = chunks + len(lengths), total + int(lengths.sum())
    return df, chunks, total


def weighed(rows: DataFrame, questions: Questions) -> Questions:
    """The questions with weights from one pass over ``lowered`` chunks; each task adds up what it has."""
    terms = pa.array(questions.terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, chunks, total = frequencies(batches, terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [chunks, total]))], names=["at", "amount"])

    counted = rows.select("text").mapInArrow(count, "at long, amount long").groupBy("at").agg(F.sum("amount").alias("amount")).toArrow()
    df = np.zeros(len(terms) + 2)  # the last two, -2 and -1, are of the whole
    df[counted["at"].to_numpy()] = counted["amount"].to_numpy()
    questions.weigh(df[:-2], int(df[-1]), int(df[-2]))
    return questions


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "query", allowed: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of every query, ties to the smaller chunk id.

    Ids are whole numbers or texts; rows of one id are chunks of their own. ``allowed`` (chunk_id) restricts what is scored; statistics
    stay those of all chunks. Chunks without an id are counted and not returned; a query
    that shares no term with any chunk has no rows.
    """
    spark, out = chunks.sparkSession, None
    rows = lowered(chunks, id_col, text_col)
    scored = rows.where(F.col("chunk_id").isNotNull())
    scored = scored if allowed is None else scored.join(allowed, "chunk_id", "left_semi")
    kind = rows.schema["chunk_id"].dataType.simpleString()
    kind = {"bigint": "long"}.get(kind, kind)
    terms, alike = asked_once(queries, query_id, query_text)
    for questions, asked in blocks_of(terms, settings):
        shared, names = spark.sparkContext.broadcast(weighed(rows, questions)), f"query_id {arrow_name(asked)}, chunk_id {kind}, score double"
        need = None
        if len(questions.ids) >= PILOT_QUERIES:
            part = scored.where(F.pmod(F.xxhash64("chunk_id"), F.lit(PILOT_PART)) == 0).coalesce(spark.sparkContext.defaultParallelism)
            first = top_k(_best_of_tasks(part, shared, None, k, asked, names), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
            reached = np.full(len(questions.ids), -np.inf)
            reached[np.searchsorted(questions.ids, identifiers(first["query_id"]))] = first["score"].to_numpy()
            need = spark.sparkContext.broadcast(reached)
        found = _best_of_tasks(scored, shared, need, k, asked, names)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], f"query_id long, chunk_id {kind}, score double, rank int")
    best = top_k(out, k).withColumnRenamed("query_id", "as_id")
    return best.join(alike, "as_id").select("query_id", *best.columns[1:])


def _best_of_tasks(scored: DataFrame, shared: Broadcast[Questions], need: Broadcast[np.ndarray] | None, k: int, asked: pa.DataType, names: str) -> DataFrame:
    """(query_id, chunk_id, score): at most k rows a query and task, none that k chunks are known to exceed."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = Sums(shared.value, k, need and need.value), None
        for batch in batches:
            ids = batch.column(0).type
            best.take(batch.column(0), split_tokens(batch.column(1)))
        best.finish()
        yield from best.batches(ids, asked)

    return scored.select("chunk_id", "text").mapInArrow(score, names)


def top_k(scores: DataFrame, k: int, by: str = "score", rank: str = "rank") -> DataFrame:
    """The k best of each query, ties to the smaller chunk id; ranks count from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), "chunk_id")
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)
