"""A stored BM25 index: postings in segments, changed by small deltas and merged by size.

Chunks are tokenised once, when they come. An addition writes one segment: shards of a few
thousand chunks, of each its ids and lengths and one row a term. Replaced and deleted chunks
stay in their segments; a table beside them names their places and another says how
many chunks each term has lost, so that statistics are exact without touching the segments.
Where four segments are of one size, they are merged into one of the next, without the
dead. A search reads the postings of its terms alone, in every segment, deals shards out
to the tasks and scores them there; k rows a query leave each task.

Versions are manifests (``commits``): several writers may add, delete and merge at the same
time. One that finds that another changed the segments it has read, or added chunks among
its ids, reads again.

Defined results: chunks without an id are not stored; null texts are empty chunks, which
count in the statistics; rows of one id in one addition are chunks of their own, and all
of them are replaced by a later addition of that id; deleting unknown ids changes nothing;
other columns are not looked at; an empty index answers no query.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import DEFAULTS, Settings
from tessera.operators.bm25 import arrow_name, lowered, question_blocks, split_tokens, top_k
from tessera.operators.commits import Commits, ConflictError, Manifest
from tessera.operators.posting_blocks import BLOCK, Best, Postings, Shard, combined, identifiers

#: Chunks of a shard, and tokens after which a shard is closed.
SHARD = 8192
SHARD_TOKENS = 4_000_000
#: Folders of a segment by a hash of the term, unless the index says how many, and the one of the chunks themselves.
PARTS = 32
CHUNKS = -1
#: Segments of one size that are merged, and how much larger the next size is.
FAN = 4
#: Terms that the scan of Parquet files is told about; more are joined.
PUSHED_TERMS = 200
#: Terms of a batch that a new shard gives.
ROWS_AT_ONCE = 10_000
RETRIES = 20
#: Types of ids.
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def part_of(term: str, parts: int) -> int:
    return zlib.crc32(term.encode()) % parts


def fields(kind: str) -> str:
    return f"shard long, part int, term string, n int, rows array<int>, tfs array<int>, top_tf array<int>, low_length array<int>, ids array<{kind}>, lengths array<int>"


def rows_of(number: int, shard: Shard, names: dict[int, str], ids: pa.DataType, parts: int) -> pa.RecordBatch:
    """A shard as rows: its chunks first, then its terms in order."""
    terms = sorted((name, i) for i, name in names.items() if i in shard.postings)
    held = [shard.postings[i] for _, i in terms]
    lists = lambda of, kind: pa.array([None, *[of(p).astype(np.int32) for p in held]], pa.list_(kind))
    none = [None] * len(held)
    columns = [
        pa.array([number] * (len(held) + 1), pa.int64()),
        pa.array([CHUNKS, *[part_of(name, parts) for name, _ in terms]], pa.int32()),
        pa.array([None, *[name for name, _ in terms]], pa.string()),
        pa.array([len(shard.ids), *[len(p.rows) for p in held]], pa.int32()),
        *[lists(of, pa.int32()) for of in (lambda p: p.rows, lambda p: p.tfs, lambda p: p.top_tf, lambda p: p.low_length)],
        pa.array([shard.ids.tolist(), *none], pa.list_(ids)),
        pa.array([shard.lengths.tolist(), *none], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields("x").split(", ")])


def shard_rows(number: int, ids: pa.Array, tokens: pa.ListArray, parts: int) -> Iterator[pa.RecordBatch]:
    """``rows_of`` a new shard, in no order of terms: all postings are sorted at once, as ``ordered`` sorts those of one term."""
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, tf = np.unique(code * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    term, row = np.divmod(key, max(1, len(lengths)))
    own = lengths[row]
    order = np.lexsort((row, -tf / (tf + 0.5 + own / max(1.0, float(lengths.mean()))), term))
    row, tf, own = row[order].astype(np.int32), tf[order].astype(np.int32), own[order].astype(np.int32)
    size = np.bincount(term, minlength=len(coded.dictionary))
    ends = np.append(0, np.cumsum(size))
    blocks = -(-size // BLOCK)
    block_ends = np.append(0, np.cumsum(blocks))
    at = np.repeat(ends[:-1], blocks) + BLOCK * (np.arange(block_ends[-1]) - np.repeat(block_ends[:-1], blocks))
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
    best = [np.maximum.reduceat(tf, at), np.minimum.reduceat(own, at)] if len(at) else [np.empty(0, np.int32)] * 2
    held = [lists(ends, row), lists(ends, tf), *(lists(block_ends, b) for b in best)]
    nothing = lambda kind, n: pa.nulls(n, pa.list_(kind))
    names, n = [f.split()[0] for f in fields("x").split(", ")], len(size)
    chunks = [pa.array([number], pa.int64()), pa.array([CHUNKS], pa.int32()), pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int32()), *[nothing(pa.int32(), 1)] * 4]
    yield pa.RecordBatch.from_arrays([*chunks, lists(np.array([0, len(ids)]), ids), lists(np.array([0, len(ids)]), lengths.astype(np.int32))], names=names)
    numbers = [pa.array(np.full(n, number)), pa.array([part_of(t, parts) for t in coded.dictionary.to_pylist()], pa.int32()), coded.dictionary, pa.array(size.astype(np.int32))]
    whole = pa.Table.from_arrays([*numbers, *held, nothing(ids.type, n), nothing(pa.int32(), n)], names=names)
    yield from whole.to_batches(max_chunksize=ROWS_AT_ONCE)


def lost_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, term, df): how many of a term's rows are dead, of (segment, shard, term, rows) sorted by shard, the row of the dead (no term) first."""
    key, dead = None, np.zeros(0, bool)
    for batch in batches:
        segment, number, terms, rows = batch.columns
        size = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.append(0, np.cumsum(size))
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        names = segment.dictionary_encode()
        shard = np.stack([names.indices.to_numpy(), number.to_numpy()], axis=1)
        cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]).any(axis=1))) if len(shard) else []
        df = np.zeros(len(size), np.int64)
        for low, high in zip(cuts, [*cuts[1:], len(size)], strict=True):
            now = (segment[low].as_py(), number[low].as_py())
            if now != key:
                key, dead = now, np.zeros(0, bool)
            if not terms[low].is_valid:
                own = flat[ends[low] : ends[low + 1]]
                dead = np.zeros(int(own.max(initial=-1)) + 1, bool)
                dead[own] = True
                low += 1
            own = flat[ends[low] : ends[high]]
            hit = np.append(0, np.cumsum(dead[np.minimum(own, len(dead) - 1)] & (own < len(dead)))) if len(dead) else np.zeros(len(own) + 1, np.int64)
            df[low:high] = np.diff(hit[ends[low : high + 1] - ends[low]])
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([segment.take(pa.array(some)), terms.take(pa.array(some)), pa.array(df[some])], names=["segment", "term", "df"])


def shards(batches: Iterator[pa.RecordBatch], number_of: dict[str, int] | None) -> Iterator[tuple[Shard, dict[int, str]]]:
    """Shards of rows that are sorted by segment and shard, those of its chunks and of the dead first.

    With ``number_of`` its numbers are used for terms, else each shard numbers its own.
    """
    key, shard, names = None, Shard(np.empty(0), np.empty(0), {}), {}
    for batch in batches:
        at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        segment, number, terms = at["segment"].to_pylist(), at["shard"].to_pylist(), at["term"].to_pylist()
        values = lambda name, i: at[name][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
        for i, term in enumerate(terms):
            if (segment[i], number[i]) != key:
                if key is not None:
                    yield shard, names
                key, shard, names = (segment[i], number[i]), Shard(np.empty(0), np.empty(0), {}), {}
            if term is None and at["ids"][i].is_valid:
                shard.ids, shard.lengths = identifiers(at["ids"][i].values), values("lengths", i).astype(np.int64)
            elif term is None:
                shard.alive = np.ones(len(shard.ids), bool) if shard.alive is None else shard.alive
                shard.alive[values("rows", i)] = False
            else:
                own = len(names) if number_of is None else number_of[term]
                names[own] = term
                shard.postings[own] = Postings(values("rows", i).astype(np.int64), values("tfs", i).astype(np.int64), values("top_tf", i).astype(np.int64), values("low_length", i).astype(np.int64))
    if key is not None:
        yield shard, names


def totals(segments: list[dict[str, Any]]) -> tuple[int, int]:
    """(chunks, tokens) that live in the segments."""
    return sum(s["chunks"] - s["dead_chunks"] for s in segments), sum(s["tokens"] - s["dead_tokens"] for s in segments)


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str, *, parts: int = PARTS, settings: Settings = DEFAULTS) -> None:
        """``parts`` is of new segments; each segment keeps its own."""
        self.spark, self.parts, self.settings, self.commits = spark, parts, settings, Commits(spark, path)
        self.path = self.commits.path

    # --- writing --------------------------------------------------------------------

    def add(self, chunks: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text") -> int:
        """Add chunks, replacing those of the same ids; returns the new version. Merge with ``compact``."""
        rows = lowered(chunks, id_col, text_col).where(F.col("chunk_id").isNotNull())
        kind = {"bigint": "long"}.get(rows.schema["chunk_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString())

        parts = self.parts

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, made, held, tokens = TaskContext.get().partitionId() << 32, 0, [], []

            def close() -> Iterator[pa.RecordBatch]:
                yield from shard_rows(base + made, pa.concat_arrays(held), pa.concat_arrays(tokens), parts)

            for batch in batches:
                held.append(batch.column(0))
                tokens.append(split_tokens(batch.column(1)))
                if sum(map(len, held)) >= SHARD or sum(len(t.values) for t in tokens) >= SHARD_TOKENS:
                    yield from close()
                    held, tokens, made = [], [], made + 1
            if held:
                yield from close()

        segment = self._write(rows.select("chunk_id", "text").mapInArrow(build, fields(kind)), kind)
        if not segment["chunks"]:
            return self.commits.read()[0]
        fresh = self._ids(segment)
        return self._change(fresh, segment)

    def delete(self, ids: DataFrame) -> int:
        """Remove the chunks of these ids (the first column); returns the new version."""
        gone = ids.select(F.col(ids.columns[0]).alias("chunk_id")).where("chunk_id is not null").distinct()
        return self._change(gone, None)

    def _write(self, rows: DataFrame, kind: str) -> dict[str, Any]:
        """A segment's files, and what a manifest says of it."""
        name = f"s-{uuid.uuid4().hex}"
        rows.sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{self.path}/{name}")
        entry: dict[str, Any] = {"name": name, "kind": kind, "parts": self.parts, "chunks": 0, "tokens": 0, "dead": [], "dead_chunks": 0, "dead_tokens": 0}
        if f"part={CHUNKS}" in self._folders(name):
            total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
            found = self._part(entry).agg(F.sum(F.size("ids")), F.sum(total), F.min(F.array_min("ids")), F.max(F.array_max("ids"))).first()
            entry |= {"chunks": found[0], "tokens": found[1], "low": found[2], "high": found[3]}
        return entry

    def _folders(self, name: str) -> list[str]:
        fs, root = self.commits.file_system(), self.commits.hadoop_path(name)
        return [s.getPath().getName() for s in fs.listStatus(root)]

    def _part(self, segment: dict[str, Any], terms: list[str] | None = None) -> DataFrame:
        """Rows of one segment: those of its chunks or, with ``terms``, those of the parts that hold them; no terms stand for all."""
        name = segment["name"]
        held = self.spark.read.schema(fields(segment["kind"])).parquet(f"{self.path}/{name}").withColumn("segment", F.lit(name))
        if terms is None:
            return held.where(F.col("part") == CHUNKS)
        parts = sorted({part_of(t, segment["parts"]) for t in terms})
        return held.where(F.col("part").isin(parts) if parts else F.col("part") != CHUNKS)

    def _all(self, segments: list[dict[str, Any]], terms: list[str] | None = None) -> DataFrame | None:
        out = None
        for segment in segments:
            rows = self._part(segment, terms)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _dead(self, segments: list[dict[str, Any]]) -> DataFrame | None:
        """(segment, shard, rows, tokens) of the dead of these segments."""
        names = sorted({d for s in segments for d in s["dead"]})
        if not names:
            return None
        return self.spark.read.schema("segment string, shard long, rows array<int>, tokens long").parquet(*[f"{self.path}/{n}/rows" for n in names]).where(F.col("segment").isin([s["name"] for s in segments]))

    def _ids(self, segment: dict[str, Any]) -> DataFrame:
        return self._part(segment).select(F.explode("ids").alias("chunk_id")).distinct()

    def _change(self, gone: DataFrame, added: dict[str, Any] | None) -> int:
        """Commit a new segment, or none, and the death of all older chunks of the ids ``gone``."""
        low, high = (added["low"], added["high"]) if added else gone.agg(F.min("chunk_id"), F.max("chunk_id")).first()
        if low is None:
            return self.commits.read()[0]
        among = lambda s: s["low"] <= high and s["high"] >= low
        for _ in range(RETRIES):
            base, manifest = self.commits.read()
            touched = [s for s in manifest.get("segments", []) if among(s)]
            deaths, name = self._bury(touched, gone) if touched else ({}, "")
            if not deaths and added is None:
                return base

            def conflicts(now: Manifest, touched=touched) -> str | None:
                return None if [s for s in now["segments"] if among(s)] == touched else "chunks of these ids were changed by another writer"

            def make(now: Manifest, deaths=deaths, name=name) -> Manifest:
                segments = []
                for s in now.get("segments", []):
                    if s["name"] in deaths:
                        n, tokens = deaths[s["name"]]
                        s = s | {"dead": [*s["dead"], name], "dead_chunks": s["dead_chunks"] + n, "dead_tokens": s["dead_tokens"] + tokens}
                    segments.append(s)
                return {"segments": [*segments, *([added] if added else [])]}

            try:
                return self.commits.change(base, make, conflicts)
            except ConflictError:
                continue
        raise ConflictError(f"other writers were first {RETRIES} times")

    def _bury(self, touched: list[dict[str, Any]], gone: DataFrame) -> tuple[dict[str, tuple[int, int]], str]:
        """Write the places of living chunks of ``gone`` in these segments, and what their terms lose.

        Returns (chunks, tokens) that each segment loses, and the folder's name.
        """
        places = self._all(touched).select("segment", "shard", F.posexplode(F.arrays_zip("ids", "lengths")).alias("row", "x")).select("segment", "shard", "row", F.col("x.ids").alias("chunk_id"), F.col("x.lengths").alias("length"))
        found = places.join(gone, "chunk_id", "left_semi")
        before = self._dead(touched)
        if before is not None:
            found = found.join(before.select("segment", "shard", F.explode("rows").alias("row")), ["segment", "shard", "row"], "left_anti")
        name = f"d-{uuid.uuid4().hex}"
        # a shard's rows are bounded by its size
        found.groupBy("segment", "shard").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.sum(F.col("length").cast("long")).alias("tokens")).write.parquet(f"{self.path}/{name}/rows")
        rows = self.spark.read.schema("segment string, shard long, rows array<int>, tokens long").parquet(f"{self.path}/{name}/rows")
        deaths = {r[0]: (r[1], r[2]) for r in rows.groupBy("segment").agg(F.sum(F.size("rows")), F.sum("tokens")).collect()}
        if deaths:
            terms = self._all([s for s in touched if s["name"] in deaths], [])
            met = terms.select("segment", "shard", "term", "rows").unionByName(rows.select("segment", "shard", F.lit(None).cast("string").alias("term"), "rows"))
            lost = met.repartition("segment", "shard").sortWithinPartitions("segment", "shard", F.col("term").isNotNull()).mapInArrow(lost_by, "segment string, term string, df long")
            lost.groupBy("segment", "term").agg(F.sum("df").alias("df")).write.parquet(f"{self.path}/{name}/terms")
        else:
            self.commits.remove(name)
        return deaths, name

    # --- merging --------------------------------------------------------------------

    def tiers(self, manifest: Manifest) -> dict[int, list[dict[str, Any]]]:
        """Segments by size: each tier is ``FAN`` times the one before. A segment without living chunks is of the least."""
        out: dict[int, list[dict[str, Any]]] = {}
        for s in manifest.get("segments", []):
            alive = max(1, s["chunks"] - s["dead_chunks"])
            tier = 0
            while FAN ** (tier + 1) <= alive:
                tier += 1
            out.setdefault(tier, []).append(s)
        return out

    def compact(self) -> int:
        """Merge tiers that hold ``FAN`` segments or more, until none does; returns how many segments were merged.

        If another writer changes one of them meanwhile, they are left for the next time.
        """
        merged = 0
        while True:
            base, manifest = self.commits.read()
            full = [t for _, t in sorted(self.tiers(manifest).items()) if len(t) >= FAN]
            if not full:
                return merged
            chosen = full[0]
            names = {s["name"] for s in chosen}
            new = self._merged(chosen)

            def conflicts(now: Manifest, chosen=chosen, names=names) -> str | None:
                return None if [s for s in now["segments"] if s["name"] in names] == chosen else "a merged segment was changed"

            def make(now: Manifest, names=names, new=new) -> Manifest:
                return {"segments": [*[s for s in now["segments"] if s["name"] not in names], *([new] if new["chunks"] else [])]}

            try:
                self.commits.change(base, make, conflicts)
            except ConflictError:
                self.commits.remove(new["name"])
                return merged
            merged += len(chosen)

    def _stream(self, segments: list[dict[str, Any]], terms: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """Rows of chunks, of the dead and of ``terms``, each shard in one task and in this order; what is not allowed counts as dead."""
        chunks = self._all(segments)
        rows = chunks.unionByName(terms).withColumn("turn", F.when(F.col("term").isNull(), 0).otherwise(2))
        dead = self._dead(segments)
        if dead is not None:
            rows = rows.unionByName(dead.drop("tokens").withColumn("turn", F.lit(1)), allowMissingColumns=True)
        if allowed is not None:
            each = chunks.select("segment", "shard", F.posexplode("ids").alias("row", "chunk_id"))
            barred = each.join(allowed, "chunk_id", "left_anti").groupBy("segment", "shard").agg(F.collect_list("row").alias("rows"))  # within a shard's size
            rows = rows.unionByName(barred.withColumn("turn", F.lit(1)), allowMissingColumns=True)
        return rows.repartition("segment", "shard").sortWithinPartitions("segment", "shard", "turn").drop("turn", "part", "n")

    def _merged(self, segments: list[dict[str, Any]]) -> dict[str, Any]:
        kind, parts = segments[0]["kind"], self.parts

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

            def close() -> pa.RecordBatch:
                whole, names = combined(held)
                return rows_of(base + made, whole, {i: t for t, i in names.items()}, KINDS[kind], parts)

            for shard, names in shards(batches, None):
                alive = len(shard.ids) if shard.alive is None else int(shard.alive.sum())
                if not alive:
                    continue
                held.append((shard, names))
                size += alive
                if size >= SHARD:
                    yield close()
                    held, size, made = [], 0, made + 1
            if held:
                yield close()

        return self._write(self._stream(segments, self._all(segments, [])).mapInArrow(merge, fields(kind)), kind)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove what none of the last ``keep`` versions names; readers and writers of older ones must have ended. Returns the folders removed."""
        versions = self.commits.versions()
        used = set()
        for version in versions[-keep:]:
            for s in self.commits.read(version)[1]["segments"]:
                used |= {s["name"], *s["dead"]}
        gone = [f for f in self.commits.folders() if f not in used]
        for name in [*gone, *(f"m{v}.json" for v in versions[:-keep])]:
            self.commits.remove(name)
        return gone

    # --- reading --------------------------------------------------------------------

    def statistics(self) -> tuple[int, int]:
        """(chunks, tokens) of all living chunks."""
        return totals(self.commits.read()[1].get("segments", []))

    def top_k(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_text: str = "query", allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank), as ``bm25_top_k`` gives over the living chunks, which ``allowed`` (chunk_id) may restrict."""
        segments, out = self.commits.read()[1].get("segments", []), None
        chunks, tokens = totals(segments)
        for questions, asked in question_blocks(queries, query_id, query_text, self.settings) if chunks else ():
            kind = segments[0]["kind"]
            few = questions.terms if len(questions.terms) <= PUSHED_TERMS else None
            all_terms = F.broadcast(self.spark.createDataFrame(pa.table({"term": pa.array(questions.terms, pa.string())})))  # bounded by the block of questions
            only = lambda rows, few=few, all_terms=all_terms: rows.where(F.col("term").isin(few)) if few else rows.join(all_terms, "term", "left_semi")
            held = only(self._all(segments, questions.terms))
            number_of = {t: i for i, t in enumerate(questions.terms)}
            df = np.zeros(len(number_of))
            counts = held.select("term", F.col("n").cast("long").alias("df"))
            dead = sorted({d for s in segments for d in s["dead"]})
            if dead:
                lost = self.spark.read.schema("segment string, term string, df long").parquet(*[f"{self.path}/{d}/terms" for d in dead])
                counts = counts.unionByName(only(lost.where(F.col("segment").isin([s["name"] for s in segments]))).select("term", (-F.col("df")).alias("df")))
            for term, n in counts.groupBy("term").agg(F.sum("df")).collect():  # no more than the questions have
                df[number_of[term]] = n
            questions.weigh(df, chunks, tokens)
            shared, asked_name = self.spark.sparkContext.broadcast((questions, number_of)), arrow_name(asked)
            ids = KINDS[kind]

            def score(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids, asked=asked) -> Iterator[pa.RecordBatch]:
                own, numbers = shared.value
                best = Best(own, k)
                for shard, _ in shards(batches, numbers):
                    best.add(shard)
                yield from best.batches(ids, asked)

            found = self._stream(segments, held, allowed).mapInArrow(score, f"query_id {asked_name}, chunk_id {kind}, score double")
            out = found if out is None else out.union(found)
        return top_k(out if out is not None else self.spark.createDataFrame([], "query_id long, chunk_id long, score double"), k)
