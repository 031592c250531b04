"""Vectors, text functions, files, streams."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphquarry.functions import text as X
from graphquarry.operators import matching, vectors
from graphquarry.sources import files
from graphquarry.streaming.changes import LatestTable, stream_upsert


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1, [1.0, 0.0, 0.0], "A"), (2, [0.9, 0.1, 0.0], "A"), (3, [0.0, 1.0, 0.0], "B"), (4, [0.0, 0.0, 0.0], "B")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, category string")


def test_knn(points):
    q = points.where("vec_id = 1")
    assert [r.vec_id for r in vectors.knn(points, q, 2).collect()] == [1, 2]
    assert [r.vec_id for r in vectors.knn(points, q, 2, "euclidean").collect()] == [1, 2]
    assert {r.category for r in vectors.knn(points, q, 10, where=F.col("category") == "B").collect()} == {"B"}
    assert vectors.knn(points, q, 10, threshold=0.5).count() == 2
    assert vectors.knn(points, q, 10).where("vec_id = 4").first().score == 0.0
    assert {(r.query_id, r.vec_id) for r in vectors.knn_join(q, points, 1).collect()} == {(1, 2)}
    every = {(r.query_id, r.rank): r.vec_id for r in vectors.knn_join(points, points, 2).collect()}
    assert every == {(r.query_id, r.rank): r.vec_id for r in vectors.knn_join(points, points, 2, block=1).collect()} and len(every) == 8
    assert vectors.count_points(points, F.col("category") == "A").first().n == 2
    assert vectors.recommend(points, [1], [3], 1).first().vec_id == 2


def test_lengths_must_agree(spark, points):
    short = spark.createDataFrame([([1.0],)], "embedding array<float>")
    with pytest.raises(Exception, match="differ in length"):
        vectors.knn(points, short, 1, "dot").collect()


def test_cleaning(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t"))).first()[0]
    assert one(X.clean_text, "  a\r\nb\rc\x00\x07 ") == "a\nb\nc"
    assert one(X.clean_document, "a \t b\n\n\n\nc") == "a b\n\nc"
    assert one(X.clean_pdf, "exam-\n ple so­ft") == "exam-ple soft"
    assert one(X.strip_markdown, "# T\n\n- **b** _i_ `c` [l](u) ![a](v)\n> q\n1. n\n---\n") == "T\nb i  l a\nq\nn\n\n"
    assert one(X.clean_markdown, "a<!-- x\ny -->b") == "ab"
    for secret in ("api_key = abcdefghijklmnopqrstu", "Bearer abcdefghijklmnopqrstuvw", "sk-" + "a" * 48, "password: hunter22", "AKIA" + "A1B2C3D4E5F6G7H8", "Authorization: Basic dXNlcg==", "http://u:p@h"):
        assert "REDACTED" in one(X.redact, f"x {secret} y"), secret
    assert one(X.token_estimate, "abcde") == 2 and one(X.token_estimate, '{"a": 1}') == 3
    meta = spark.createDataFrame([("---\ntitle: 'A b'\n---\n# H\n[l](u) ![i](v)\n```x```",)], "t string").select(X.markdown_metadata(F.col("t")).alias("m")).first().m
    assert (meta.n_headers, meta.n_links, meta.n_images, meta.n_code_blocks, meta.front_matter) == (1, 1, 1, 1, {"title": "A b"})


def test_chunks():
    assert X.semantic_chunks("short", 1000) == ["short"] and X.semantic_chunks(" \n ") == X.semantic_chunks(None) == []
    assert len(X.semantic_chunks("one para.\n\ntwo para here.\n\nthree para too.", 30, 5)) > 1
    assert all(len(c) <= 50 for c in X.semantic_chunks("a" * 200, 50, 10)) and len(X.semantic_chunks("a" * 200, 50, 10)) == 5
    sentences = " ".join(f"Sentence number {i}." for i in range(40))
    assert len(X.semantic_chunks(sentences, 100, 60)) > len(X.semantic_chunks(sentences, 100, 0))
    assert X.semantic_chunks("a\r\nb\rc", 100) == ["a\nb\nc"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n!", max_size=300), st.integers(5, 60), st.integers(0, 20))
def test_chunks_hold_all_and_fit(text, size, overlap):
    chunks = X.semantic_chunks(text, size, overlap)
    # a chunk starts with units of the one before, which the first new unit may top by its length and the glue between them
    assert all(len(c) <= overlap + len("\n\n") + size for c in chunks)
    letters = lambda s: "".join(s.split())
    if overlap == 0:
        assert "".join(map(letters, chunks)) == letters(text)


def test_char_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, None), (3, ""), (4, "    ")], "id long, t string")
    got = {(r.id, r.chunk_index): r.content for r in X.char_chunks(df, "t", 4, 1).collect()}
    assert got == {(1, 0): "abcd", (1, 1): "defg", (1, 2): "ghij", (1, 3): "j"}


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x\r\ny\x00 ")
    (tmp_path / "b.md").write_text("# T\n<!-- c -->\ntext")
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hi</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:p><w:r><w:t>there</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(doc.getvalue())
    read = lambda n: files.load(spark, str(tmp_path / n)).first().content
    assert read("a.TXT") == "x\ny" and read("b.md") == "# T\n\ntext" and read("c.docx") == "Hi you\nthere"
    with pytest.raises(KeyError):
        files.extractor_for("x.exe")
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "z")], "file_id long, chunk_index int, content string")
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    assert [r.content for r in files.file_chunks(spark, str(tmp_path / "chunks"), 1).collect()] == ["a", "b"]
    assert files.without_file(chunks, spark.createDataFrame([(1,)], "file_id long")).count() == 1


def test_matching(spark):
    q = spark.createDataFrame([(1, "Which volunteers work weekends?")], "question_id long, question string")
    e = spark.createDataFrame([(1, "volunteers weekends shifts people"), (2, "volunteers only"), (3, "nothing in common here at least")], "example_id long, example string")
    assert {(r.example_id, r.overlap) for r in matching.keyword_match(q, e).collect()} == {(1, 2), (2, 1)}
    hits = spark.createDataFrame([(1, "P", "a", 0.9), (1, "P", "a", 0.8), (1, "P", "b", 0.7), (1, "T", "c", 0.1)], "question_id long, entity string, scope string, score double")
    assert [(r.scope, r.score) for r in matching.scope_match(hits, 2, 0.5).collect()] == [("a", 0.9), ("b", 0.7)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "a"), (2, 1, "b"), (1, 3, "c"), (1, 2, "d")]
    schema = "k long, v long, x string"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    table = LatestTable(spark, str(tmp_path / "table"), spark.createDataFrame([], schema).schema, "k", ("v",))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    stream_upsert(feed, table, str(tmp_path / "checkpoint")).awaitTermination()
    assert {tuple(r) for r in table.read().collect()} == {(1, 3, "c"), (2, 1, "b")}
    last = table.versions()[-1]
    table.merge(spark.createDataFrame([rows[-1]], schema), last)  # a batch run again
    assert table.versions()[-1] == last and {tuple(r) for r in table.read().collect()} == {(1, 3, "c"), (2, 1, "b")}
    spark.createDataFrame([(2, 9, "z")], schema).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    again = LatestTable(spark, str(tmp_path / "table"), table.schema, "k", ("v",))  # a restarted driver
    stream_upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), again, str(tmp_path / "checkpoint")).awaitTermination()
    assert {tuple(r) for r in again.read().collect()} == {(1, 3, "c"), (2, 9, "z")}
    table.merge(spark.createDataFrame([(3, 1, "n")], schema), last + 5)
    assert len(table.versions()) == 2 and table.read().count() == 3  # superseded versions go


def test_redaction_by_signs(spark):
    """Texts without any sign of a secret come back as they are; each pattern alone shows one."""
    secrets = ["API-KEY: 'abcdefghijklmnopqrstu'", "Bearer abcdefghijklmnopqrstuvw", "sk-" + "a" * 48, "sk-ant-" + "b" * 95, "Token=abcdefghijklmnopqrstu", "PassWord: abc", "passwd=abc", "PWD=abc", "db_password=abc", "AKIA" + "A1B2C3D4E5F6G7H8", "a/b+" * 10, "Authorization: Basic dXNlcg==", "//u:p@h"]
    rows = spark.createDataFrame([(s,) for s in [*secrets, "plain words", ""]] + [(None,)], "t string")
    got = rows.select("t", X.redact(F.col("t")).alias("r"), X._chain(F.col("t"), X.SECRETS).alias("w")).collect()
    assert len(secrets) == len(X.SECRETS) and all(r.r == r.w for r in got)
    assert sum(r.t is not None and r.r != r.t for r in got) == len(secrets)


def test_chunks_repeat_whole_units():
    units = [f"Sentence number {i} of them." for i in range(40)]
    chunks = X.semantic_chunks(" ".join(units), 100, 30)
    assert all(len(c) <= 100 for c in chunks) and chunks[0].startswith(units[0]) and chunks[-1].endswith(units[-1])
    for a, b in zip(chunks, chunks[1:]):  # the last sentence of a chunk opens the next one
        assert b.startswith(a[a.rindex("Sentence") :])


def test_chunk_store(spark, tmp_path):
    path = str(tmp_path / "chunks")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "file_id long, chunk_index int, content string")
    files.write_chunks(chunks, path)
    assert files.has_chunks(spark, path, 1) and not files.has_chunks(spark, path, 3)
    assert [r.content for r in files.file_chunks(spark, path, 1).collect()] == ["a", "b"]
    left = files.without_file(spark.read.parquet(path), chunks.where("file_id = 1"))
    assert {tuple(r) for r in files.count_chunks(left).collect()} == {(2, 1)}
