"""Readers, writers, streaming forms and the composed plans."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators.chunking import chunk_pages
from tessera.operators.layout import layout_text
from tessera.operators.store import ChunkStore
from tessera.plans.chat import chat
from tessera.plans.ingest import embedded, ingest
from tessera.sources import readers, sinks
from tessera.streaming.limiter import rate_limit, rate_limit_stream
from tessera.streaming.live import ingest_stream, request_counters, windowed_counters

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def p(text: str, style: str = "") -> str:
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=%s/></w:pPr>' % repr(style).replace(chr(39), chr(34)) if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def tbl(*rows: list[str]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def test_text_pages():
    assert readers.text_pages("a\x0c \x0cb".encode()) == [(1, "a"), (2, "b")]
    assert readers.text_pages("é".encode("latin-1")) == [(1, "é")]
    with pytest.raises(ValueError):
        readers.text_pages(b" \x0c ")


def test_docx_headings_then_tables():
    data = docx(p("Top", "Heading1"), tbl(["Setting", ""], ["DAYS", "45"]), p("tail"), tbl(["lone", "row"]))
    assert readers.docx_pages(data)[0][1].replace("\n\n\n", "\n\n") == "## Top\n\n\ntail\n\n\nSetting: DAYS | Col2: 45\n\n\n\nlone | row".replace("\n\n\n", "\n\n")
    with pytest.raises(ValueError):
        readers.docx_pages(docx())


def test_files_dispatch_by_extension(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("one\x0ctwo")
    (tmp_path / "b.docx").write_bytes(docx(p("word")))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.md").write_text(" ")
    found = readers.read_files(spark, f"file://{tmp_path}").collect()
    assert {(r.source, r.page) for r in found if r.error is None} == {("a.TXT", 1), ("a.TXT", 2), ("b.docx", 1)}
    assert {r.source for r in found if r.error} == {"c.pdf", "d.exe", "e.md"}
    pdf = readers.read_files(spark, f"file://{tmp_path}", pdf_parser=lambda data: [(1, "x"), (3, "y")]).where("source = 'c.pdf'").collect()
    assert sorted(r.page for r in pdf) == [1, 3]


def test_structured_sources(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"query": "a"}\n\nnot json\n{"query": "b"}\n')
    assert [r.query for r in readers.read_jsonl(spark, f"file://{tmp_path}/l.jsonl", "query string", tolerant=True).orderBy("query").collect()] == ["a", "b"]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, f"file://{tmp_path}/l.jsonl", "query string").collect()
    assert sorted(map(tuple, readers.read_numbered_jsonl(spark, f"file://{tmp_path}/l.jsonl", "query string").collect())) == [(1, "a"), (4, "b")]
    intents = readers.parse_intents("# bank\ngeneral:\n  - hi\n  - 'you there'\nrag:\n- find it\n")
    assert intents == {"general": ["hi", "you there"], "rag": ["find it"]}
    assert [tuple(r) for r in readers.read_exemplars(spark, intents).orderBy("exemplar_id").collect()][2] == (2, "rag", 0, "find it")
    long = "c" * 120
    qas = [{"id": "1", "question": "q?", "is_impossible": False, "answers": [{"text": "x"}, {"text": "x"}]}, {"id": "2", "question": "r?", "is_impossible": True, "answers": []}]
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"title": "T", "paragraphs": [{"context": long, "qas": qas}, {"context": "short", "qas": qas}]}]}))
    passages, questions = readers.read_question_sets(spark, f"file://{tmp_path}/s.json")
    assert passages.count() == 1 and [(r.query, r.answers) for r in questions.collect()] == [("q?", ["x"])]


def test_layout_replaces_blocks_by_tables(spark):
    box = "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string"
    blocks = spark.createDataFrame([(1, 1, 0.0, 50.0, 10.0, 60.0, "after"), (1, 1, 0.0, 0.0, 10.0, 10.0, " before "), (1, 1, 0.0, 20.0, 10.0, 30.0, "cell"), (1, 1, 0.0, 38.0, 10.0, 48.0, "edge"), (1, 2, 0.0, 0.0, 1.0, 1.0, " ")], box)
    tables = spark.createDataFrame([(1, 1, 0.0, 18.0, 10.0, 40.0, "A: 1\nA: 2"), (2, 1, 0.0, 0.0, 1.0, 1.0, "B: 1")], box)
    found = {(r.doc_id, r.page): r.text for r in layout_text(blocks, tables).collect()}
    assert found == {(1, 1): "before\nA: 1\nA: 2\nedge\nafter", (2, 1): "B: 1"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1)], "x string, n int")
    sinks.write_csv(df, f"file://{tmp_path}/csv")
    sinks.write_jsonl(df, f"file://{tmp_path}/json")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/csv").first().x == "a|b"
    assert [r.line for r in sinks.markdown_rows(df).collect()] == ["| x | n |", "|---|---|", "| a\\|b | 1 |"]
    none = sinks.exposition(spark.createDataFrame([], "intent string, status int, n long"), spark.createDataFrame([], "name string, value double")).collect()
    assert 'gateway_requests_total{intent="none",status="200"} 0' in [r.line for r in none]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, f"u{i % 3}", 1000 + i * 7 % 300, "t", 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, user_id string, s int, event_type string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")

    def run(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(rate_limit_stream(stream(), limit=2, window=60), "append", "limited") == sorted(map(tuple, rate_limit(df, limit=2, window=60).collect()))
    assert run(request_counters(stream()), "complete", "counted") == sorted(map(tuple, request_counters(df).collect()))
    assert run(windowed_counters(stream(), width="1 minute"), "complete", "windowed") == sorted(map(tuple, windowed_counters(df, width="1 minute").collect()))


def test_ingest_refuses_known_content_and_a_stream_may_replay(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Title\nCall 555-123-4567 now. " + "More words here. " * 40)
    (docs / "b.md").write_bytes((docs / "a.md").read_bytes())
    (docs / "c.bin").write_text("x")
    held = ChunkStore(spark, f"file://{tmp_path}/store")
    assert ingest(spark, f"file://{docs}", held) == {"added": 1, "refused": 1, "failed": 1}
    table = held.read()
    assert table.where(F.contains("text", F.lit("<PHONE_NUMBER>"))).count() > 0 and table.where("size(v) <> 64").count() == 0
    assert ingest(spark, f"file://{docs}", held, strategies=["semantic"])["added"] == 0
    pages = spark.createDataFrame([(5, "p.md", 1, "One. Two.")], "doc_id long, source string, page int, text string")
    pages.write.parquet(f"file://{tmp_path}/pages")
    live = ChunkStore(spark, f"file://{tmp_path}/live")
    for attempt in ("one", "two"):
        source = spark.readStream.schema(pages.schema).parquet(f"file://{tmp_path}/pages")
        ingest_stream(source, live, lambda b: chunk_pages(b, ["structure"]), f"file://{tmp_path}/{attempt}").awaitTermination(120)
    assert live.read().count() == 1


def test_chat_over_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "find the retention policy document"), (2, 0, "user", "hello there friend"), (3, 0, "user", "x" * 40_000)], "conv_id long, turn long, role string, text string")
    bank = embedded(spark.createDataFrame([(0, "rag", "find the policy document"), (1, "general", "hello there my friend")], "exemplar_id long, intent string, text string"))
    chunks = embedded(spark.createDataFrame([(9, "The retention policy document says 45 days. More.", "p.md", 1)], "chunk_id long, text string, source string, page int"))
    found = {r.conv_id: r for r in chat(turns, bank, chunks, intents=["general", "rag"]).collect()}
    assert found[1].intent == "rag" and found[1].answer == "The retention policy document says 45 days. [1]"
    assert found[2].intent == "general" and found[2].answer is None and found[3].status == 400 and found[3].intent is None
    down = {r.conv_id: r for r in chat(turns, bank, None, intents=["general", "rag"]).collect()}
    assert down[1].route == "hf_local" and down[1].warning == "no_documents_indexed"
