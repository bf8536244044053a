"""Binary output of token ids: one shared zstandard dictionary, each document compressed alone.

A folder holds one dictionary file and shards in ascending order of document id.
A shard is

    b"TSZD\\x01"
    frames          one zstandard frame a document, made with the shared dictionary
    index           of each document: doc id (int64), offset (uint64), frame length (uint32),
                    ids (uint32), and a byte that is 1 where the document id is null
    header (JSON)   the dictionary's SHA-256, bytes an id, documents, ids, tokenizer
    index offset (uint64), header length (uint32), b"TSZD\\x01"

so one document is read with two seeks and without its neighbours.

Defined results: a null or empty text has only the end id; repeated rows and
equal document ids are all kept, next to each other; a null document id sorts
first; a very long text is one frame; an empty table gives a folder with a
dictionary and no documents; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import within_bytes
from tessera.llm.storage import make_folder, reading, replacing
from tessera.llm.tokens import encoder

MAGIC = b"TSZD\x01"
TAIL = "<QI5s"
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u4"), ("null", "u1")])
#: The dictionary is trained on about so many documents, chosen by a hash of their id.
SAMPLE_DOCS = 1500
#: Bytes of serialized ids that training takes at most.
SAMPLE_BYTES = 8_000_000
#: Bytes of the texts that the driver takes for that at most.
SAMPLE_TEXT = 32_000_000
DICT_BYTES = 65_536
LEVEL = 3


def serialized(ids: bytes, width: int) -> bytes:
    """Little-endian ids of ``width`` bytes from little-endian 32-bit ids; one that does not fit is an error."""
    if width == 4:
        return ids
    wide = np.frombuffer(ids, "<u4")
    if wide.size and wide.max() >> 16:
        raise ValueError("an id is too large for two bytes")
    return wide.astype("<u2").tobytes()


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary; with too little to train on, the samples themselves serve as raw content."""
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def sample_texts(docs: DataFrame, id_col: str, text_col: str, docs_wanted: int = SAMPLE_DOCS) -> list[str]:
    """About ``docs_wanted`` whole texts, of ``SAMPLE_TEXT`` bytes at most, chosen by a hash of the id."""
    total = docs.count()
    keep = 1 << 62 if total <= docs_wanted else int((1 << 62) * docs_wanted / total)
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("dictionary"), F.col(id_col)), 2)
    return [r[0] or "" for r in within_bytes(docs.where(turn < keep), turn, F.col(text_col), SAMPLE_TEXT).select(text_col).collect()]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, *, style: str = "byte_level", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode all ``docs`` and write them under ``path``; returns one manifest entry a shard, in order.

    Rows are dealt into ranges of the id (texts, not the larger ids, are
    shuffled), sorted there, and written by one task a range; rows of one id are told
    apart by their length. Ids take two bytes if the tokenizer's whole vocabulary
    fits into them, else four. The manifest has one small entry a shard and is all
    that the driver sees besides the sample.
    """
    make_folder(path)
    coder = encoder(tokenizer, style)
    width = 2 if max(coder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 65_536 else 4
    end, samples, room = end_id.to_bytes(4, "little"), [], SAMPLE_BYTES
    for text in sorted(sample_texts(docs, id_col, text_col)):
        if room > 0:
            samples.append(serialized(coder.ids(text) + end, width))
            room -= len(samples[-1])
    dictionary = train(samples)
    digest = hashlib.sha256(dictionary).hexdigest()
    with replacing(f"{path}/dictionary.zdict") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        ids_of, offset, total, parts = encoder(tokenizer, style).ids, len(MAGIC), 0, []
        shared = as_dictionary(dictionary)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True, write_checksum=False)
        with replacing(f"{path}/shard-{shard:06d}.tszd") as out:
            out.write(MAGIC)
            while first is not None:
                keys, texts = first.column(0).to_pylist(), first.column(1)
                index = np.zeros(len(keys), INDEX)
                frames = []
                for i, (key, text) in enumerate(zip(keys, texts, strict=True)):
                    ids = ids_of(text.as_py()) + end
                    frame = press.compress(serialized(ids, width))
                    index[i] = (key or 0, offset, len(frame), len(ids) // 4, key is None)
                    frames.append(frame)
                    offset += len(frame)
                    total += len(ids) // 4
                out.write(b"".join(frames))
                parts.append(index)
                first = next(batches, None)
            index = np.concatenate(parts)
            header = json.dumps({"dictionary": digest, "width": width, "docs": len(index), "ids": total, "end_id": end_id}).encode()
            out.write(index.tobytes() + header + struct.pack(TAIL, offset, len(header), MAGIC))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(index)], "ids": [total], "bytes": [offset], "dictionary": [digest]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    length = F.octet_length("text")
    dealt = rows.repartitionByRange("doc_id", length).sortWithinPartitions("doc_id", length, F.xxhash64("text"))
    found = dealt.mapInArrow(write, "shard long, docs long, ids long, bytes long, dictionary string").collect()
    manifest, start = [], 0
    for r in sorted(found, key=lambda r: r.shard):
        manifest.append({"path": f"{path}/shard-{r.shard:06d}.tszd", "start": start, "docs": r.docs, "ids": r.ids, "bytes": r.bytes, "dictionary": r.dictionary})
        start += r.ids
    return manifest


class Shard:
    """Random access to one shard: ``ids(i)`` decodes its i-th document alone."""

    def __init__(self, source, dictionary: bytes) -> None:
        self.source, size = source, source.size()
        source.seek(size - struct.calcsize(TAIL))
        at, length, magic = struct.unpack(TAIL, source.read(struct.calcsize(TAIL)))
        source.seek(size - struct.calcsize(TAIL) - length)
        self.header = json.loads(source.read(length))
        if magic != MAGIC or self.header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("not a token shard of this dictionary")
        source.seek(at)
        self.index = np.frombuffer(source.read(size - struct.calcsize(TAIL) - length - at), INDEX)
        self.unpress = zstandard.ZstdDecompressor(dict_data=as_dictionary(dictionary))

    def _widened(self, frame: bytes) -> bytes:
        raw = self.unpress.decompress(frame)
        return raw if self.header["width"] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()

    def ids(self, i: int) -> bytes:
        self.source.seek(int(self.index[i]["offset"]))
        return self._widened(self.source.read(int(self.index[i]["length"])))

    def all(self, at_once: int = 512) -> Iterator[tuple[np.void, bytes]]:
        for low in range(0, len(self.index), at_once):
            some = self.index[low : low + at_once]
            begin = int(some[0]["offset"])
            self.source.seek(begin)
            block = self.source.read(int(some[-1]["offset"]) + int(some[-1]["length"]) - begin)
            for entry in some:
                at = int(entry["offset"]) - begin
                yield entry, self._widened(block[at : at + int(entry["length"])])


def read_token_files(spark: SparkSession, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """Every document of the shards: doc_id, start, n_tokens, ids_crc32, frame_bytes and, if wanted, ids."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long, dictionary string" + ", ids array<int>" * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "frame_bytes", "dictionary"] + ["ids"] * with_ids
    if not manifest:
        return spark.createDataFrame([], fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                with reading(entry["path"].rpartition("/")[0] + "/dictionary.zdict") as source:
                    dictionary = source.read()
                with reading(entry["path"]) as source:
                    start, rows, shard = entry["start"], [], Shard(source, dictionary)
                    for at, ids in shard.all():
                        n = len(ids) // 4
                        row = (None if at["null"] else int(at["doc_id"]), start, n, zlib.crc32(ids), int(at["length"]), shard.header["dictionary"])
                        rows.append((*row, np.frombuffer(ids, "<i4").tolist()) if with_ids else row)
                        start += n
                        if len(rows) >= (500 if with_ids else 20_000):
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    return shards.repartition(min(len(manifest), 10_000)).mapInArrow(read, fields)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"dictionary": pa.string(), "ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
