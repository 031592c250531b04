"""The file ledger: done, skipped, failed, changed and forced files."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from graphquarry.functions.embed import HashEmbedder, embed_distinct
from graphquarry.sources.processing import FileStore
from graphquarry.streaming.changelog import StepFailed


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in" / "deep er"
    at.mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("Some plain text.")
    (at / "b.MD").write_text("# Title\n\n" + "A sentence of it. " * 200)
    (at / "c.docx").write_bytes(docx("one", "two"))
    (at / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "latin.log").write_bytes("é".encode("latin-1"))
    (tmp_path / "in" / "empty.txt").write_text(" \n ")
    (tmp_path / "in" / "x.exe").write_bytes(b"\x00\x01")
    (tmp_path / "in" / "noname").write_text("text")
    return tmp_path / "in"


@pytest.fixture
def store(spark, tmp_path):
    return FileStore(spark, f"file://{tmp_path}/store", lambda df, c: embed_distinct(df, c, HashEmbedder(8)), buckets=2)


def run(store, folder, **how):
    return {r.name: (r.status, r.error) for r in store.process(f"file://{folder}", **how).collect()}


FAILED = {
    "deep er/broken.docx": ("failed", "BadZipFile: File is not a zip file"), "latin.log": ("failed", "not UTF-8"), "empty.txt": ("failed", "no text"),
    "x.exe": ("failed", "unsupported type: exe"), "noname": ("failed", "unsupported type: "),
}
GOOD = ("a.txt", "deep er/b.MD", "deep er/c.docx")


def test_runs(store, folder):
    assert run(store, folder) == {**FAILED, **{n: ("done", None) for n in GOOD}}
    chunks = {(r.name, r.chunk_index): r for r in store.chunks().collect()}
    assert chunks["a.txt", 0].content == "Some plain text." and chunks["deep er/c.docx", 0].content == "one\ntwo"
    b = [r for (n, _), r in chunks.items() if n.endswith("b.MD")]
    assert len(b) > 1 and {r.total_chunks for r in b} == {len(b)} and all(len(r.embedding) == 8 for r in b)
    assert run(store, folder) == {**FAILED, **{n: ("skipped", None) for n in GOOD}}
    (folder / "deep er" / "b.MD").write_text("Short now.")
    (folder / "latin.log").write_text("é")
    want = {**FAILED, "latin.log": ("done", None), "a.txt": ("skipped", None), "deep er/b.MD": ("done", None), "deep er/c.docx": ("skipped", None)}
    assert run(store, folder) == want
    assert {(r.name, r.content) for r in store.chunks().collect() if r.name.endswith("b.MD")} == {("deep er/b.MD", "Short now.")}
    forced = run(store, folder, force=True)
    assert {n for n, (s, _) in forced.items() if s == "done"} == {*GOOD, "latin.log"}
    store.forget(store.spark.createDataFrame([("a.txt",)], "name string"))
    assert "a.txt" not in {r.name for r in store.ledger().collect()} | {r.name for r in store.chunks().collect()}
    store.sweep(1)
    assert run(store, folder)["a.txt"] == ("done", None)


def test_a_run_that_dies_is_run_again(store, folder):
    embed, store.embed = store.embed, lambda df, c: df.withColumn("embedding", F.raise_error(F.lit("no model")).cast("array<float>"))
    with pytest.raises(StepFailed, match="chunks"):
        store.process(f"file://{folder}")
    assert store.ledger().count() == 0 and store.chunks().count() == 0
    store.embed = embed
    assert run(store, folder)["a.txt"] == ("done", None)
    (folder / "a.txt").write_bytes(b"\xff\xfe")
    assert run(store, folder)["a.txt"] == ("failed", "not UTF-8")
    assert "a.txt" not in {r.name for r in store.chunks().collect()}


def test_files_are_written_part_by_part(spark, tmp_path, store):
    """A file may be larger than any task holds: its parts are rows, repeated ones included, and what is processed isn't stored whole."""
    from graphquarry.sources.processing import write_files

    rows = [("a.txt", 3, "third"), ("a.txt", 1, "first"), ("b.txt", 1, "alone"), ("a.txt", 2, "second"), ("a.txt", 3, "third")]
    df = spark.createDataFrame(rows, "name string, part int, content string").withColumn("content", F.encode("content", "UTF-8")).withColumn("before", F.lit(b"-"))
    write_files(df, f"file://{tmp_path}/in", "part")
    assert (tmp_path / "in" / "a.txt").read_text() == "first-second-third-third" and (tmp_path / "in" / "b.txt").read_text() == "alone"
    assert run(store, tmp_path / "in") == {"a.txt": ("done", None), "b.txt": ("done", None)}
    assert {r.name: r.text_length for r in store.ledger().collect()} == {"a.txt": 24, "b.txt": 5}
