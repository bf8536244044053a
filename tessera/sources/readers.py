"""Readers: text and Markdown pages, Word documents, JSON lines, exemplars, nested question sets.

Files come through Spark's ``binaryFile`` source, so any storage that Spark reads
will do, and are parsed by extension in Arrow functions. PDF pages need a parser
that is not part of this environment: give one with ``pdf_parser``.
"""

from __future__ import annotations

import io
import shutil
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import EXTENSIONS

Pages = list[tuple[int, str]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Splits whose first line numbers are broadcast at most.
SPLITS = 200_000


def text_pages(data: bytes) -> Pages:
    """UTF-8, else Latin-1; form feeds part pages, blank pages are dropped and the rest numbered anew."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    pages = [p.strip() for p in text.split("\x0c")]
    found = [(i, p) for i, p in enumerate((p for p in pages if p), 1)]
    if not found:
        raise ValueError("no text in the file")
    return found


def serialize_rows(rows: list[list[str]]) -> list[str]:
    """Table rows as ``Header: cell`` joined by bars; a lone row, or one without any header, as bare cells."""
    rows = [[" ".join(c.split()) for c in row] for row in rows]
    if not rows:
        return []
    headed = any(rows[0]) and len(rows) > 1
    names = [h or f"Col{i}" for i, h in enumerate(rows[0], 1)]
    out = []
    for row in rows[headed:]:
        cells = [f"{names[i] if i < len(names) else f'Col{i + 1}'}: {c}" if headed else c for i, c in enumerate(row) if c]
        if cells:
            out.append(" | ".join(cells))
    return out


def docx_pages(data: bytes) -> Pages:
    """One page: all paragraphs, headings marked, then all tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in archive.namelist():
            for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = "" if name is None else name.get(f"{_W}val", "")

    def plain(element) -> str:
        return "".join("\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else e.text or "" for e in element.iter() if e.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    blocks: list[str] = []
    for paragraph in body.findall(f"{_W}p"):
        text = plain(paragraph).strip()
        if text:
            style = paragraph.find(f"{_W}pPr/{_W}pStyle")
            key = "" if style is None else style.get(f"{_W}val", "")
            name = names.get(key, key).lower()
            blocks.append(f"\n## {text}\n" if "heading" in name or "title" in name else text)
    for table in body.findall(f"{_W}tbl"):
        rows = serialize_rows([[plain(cell) for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")])
        if rows:
            blocks.append("\n" + "\n".join(rows) + "\n")
    text = "\n\n".join(blocks).strip()
    if not text:
        raise ValueError("no text in the file")
    return [(1, text)]


#: A page with less text than this is given to the text recogniser.
OCR_LEAST = 60


def ocr_available(command: str | None = None, places: tuple[str, ...] = ("tesseract",)) -> str | None:
    """The text recogniser's command: the one that is set, else the first of ``places`` that is found; None without any."""
    return next((found for place in ([command] if command else places) if (found := shutil.which(place))), None)


def with_ocr(pages: Pages, recognise: Callable[[int], str]) -> Pages:
    """Pages whose text is missing or short with what ``recognise`` reads on them, unless that is what they have."""
    out = []
    for number, text in pages:
        own = (text or "").strip()
        if len(own) < OCR_LEAST:
            read = (recognise(number) or "").strip()
            own = "\n".join(x for x in (own, read if read != own else "") if x)
        if own:
            out.append((number, own))
    return out


def parse_pages(name: str, data: bytes, pdf_parser: Callable[[bytes], Pages] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> Pages:
    """Pages of a file by the extension of its name; ``ocr`` reads a page of a PDF that has little text."""
    extension = f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""
    if extension in (".txt", ".md"):
        return text_pages(data)
    if extension == ".docx":
        return docx_pages(data)
    if extension == ".pdf" and pdf_parser is not None:
        pages = pdf_parser(data)
        return with_ocr(pages, lambda number: ocr(data, number)) if ocr is not None else pages
    raise ValueError(f"unsupported file type: {extension or name}" if extension not in EXTENSIONS else "no PDF parser was given")


def read_files(spark: SparkSession, path: str, *, pdf_parser: Callable[[bytes], Pages] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """(path, source, content_hash, page, text, error) of all files under ``path``; a file that fails has its reason."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "source", "content_hash", "page", "text", "error"]
        for batch in batches:
            for row in batch.to_pylist():
                source = row["path"].rsplit("/", 1)[-1]
                try:
                    pages, error = parse_pages(source, row["content"], pdf_parser, ocr), None
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    pages, error = [(None, None)], str(e)
                n = len(pages)
                columns = [[row["path"]] * n, [source] * n, [row["content_hash"]] * n, [p for p, _ in pages], [t for _, t in pages], [error] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "page" else pa.string()) for k, c in zip(names, columns, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("content_hash"))
    return files.mapInArrow(parse, "path string, source string, content_hash string, page int, text string, error string")


def read_text_table(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, page, text): pages of a text table, parted at form feeds; native."""
    from tessera.functions.text import not_blank, strip_ws

    pages = not_blank(F.transform(F.split(F.col(text_col), "\f"), strip_ws))
    return documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.posexplode(pages).alias("page", "text")).withColumn("page", F.col("page") + 1)


def read_jsonl(spark: SparkSession, path: str, schema: str, *, tolerant: bool = False) -> DataFrame:
    """JSON lines with a schema; a malformed line fails the job, or is dropped if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_num, line): lines of text files with their numbers from 1, read split by split.

    A split's lines are in its task in their order, so that a number within the split comes
    from a counter; how many lines the splits before it have is a running sum over one row a
    split. Lines end at line feeds; blank ones count.
    """
    parts = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    sizes = parts.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).drop("n")
    sizes = F.broadcast(sizes) if sizes.limit(SPLITS + 1).count() <= SPLITS else sizes
    return parts.join(sizes, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_num"), "line")


def parsed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_num, malformed, r) of every line that is not blank; ``r`` has the schema's columns."""
    lines = numbered_lines(spark, path).where(F.trim(F.regexp_replace("line", r"\r$", "")) != "")
    parsed = lines.select("file", "line_num", F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("file", "line_num", F.col("r._corrupt").isNotNull().alias("malformed"), F.col("r").dropFields("_corrupt").alias("r"))


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line_num, the schema's columns) of JSON line files of any size: blank lines are skipped, malformed ones dropped, numbers count from 1 in each file."""
    return parsed_lines(spark, path, schema).where(~F.col("malformed")).select(F.col("line_num").cast("int").alias("line_num"), "r.*")


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, lines, malformed): of each file, how many lines are not blank and how many of these no JSON of the schema."""
    return parsed_lines(spark, path, schema).groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.col("malformed").cast("long")).alias("malformed"))


def read_exemplars(spark: SparkSession, intents: dict[str, list[str]]) -> DataFrame:
    """(exemplar_id, intent, ord, text) of a map from intent to sentences, in its order."""
    rows = [(i, intent, o, text) for i, (intent, o, text) in enumerate((intent, o, t) for intent, texts in intents.items() for o, t in enumerate(texts))]
    return spark.createDataFrame(rows, "exemplar_id long, intent string, ord int, text string")


def parse_intents(text: str) -> dict[str, list[str]]:
    """A YAML file of intents, each with a list of sentences: the subset of YAML that such files use."""
    found: dict[str, list[str]] = {}
    own: list[str] | None = None
    for line in text.splitlines():
        bare = line.split(" #", 1)[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or bare.strip() == "---":
            continue
        if bare.lstrip().startswith("- "):
            if own is None:
                raise ValueError(f"a sentence without an intent: {line}")
            own.append(bare.lstrip()[2:].strip().strip("\"'"))
        elif bare.endswith(":"):
            name = bare[:-1].strip().strip("\"'")
            own = found.setdefault(name, [])
        else:
            raise ValueError(f"neither an intent nor a sentence: {line}")
    return {k: v for k, v in found.items() if v}


SQUAD = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<id string, question string, is_impossible boolean, answers array<struct<text string>>>>>>>>"


def read_question_sets(spark: SparkSession, path: str, least_chars: int = 100) -> tuple[DataFrame, DataFrame]:
    """(passages, questions) of a nested question set: long contexts, and answerable questions with distinct answers."""
    raw = spark.read.schema(SQUAD).option("multiLine", "true").json(path)
    contexts = raw.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", "p.qas").where(F.length("context") >= least_chars)
    passages = contexts.select(F.xxhash64("context").alias("doc_id"), "title", F.col("context").alias("text")).dropDuplicates(["doc_id"])
    questions = contexts.select(F.xxhash64("context").alias("gold_doc_id"), "title", F.explode("qas").alias("q")).select("gold_doc_id", "title", F.col("q.question").alias("query"), F.array_distinct(F.transform("q.answers", lambda a: a["text"])).alias("answers"), F.coalesce("q.is_impossible", F.lit(False)).alias("impossible"))
    return passages, questions.where(~F.col("impossible") & (F.trim("query") != "") & (F.size("answers") > 0)).drop("impossible")
