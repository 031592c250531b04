"""Texts that come in parts give what the whole text gives, and files larger than a reader's row are processed."""

import hashlib
import io
import random
import subprocess
import sys
import tracemalloc
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from graphquarry.functions import streams as S
from graphquarry.functions import text as X
from graphquarry.functions.embed import HashEmbedder, embed_distinct
from graphquarry.sources import files, processing


def parted(text, rng):
    """Parts of random sizes, empty ones included."""
    parts = []
    while text:
        n = rng.choice((0, 1, 1, 2, 3, 7, 50, 400))
        parts.append(text[:n])
        text = text[n:]
    return parts


PIECES = ["a", "word", "é😀", ".", "! ", "?\n", " ", "   ", "\t", "\n", "\n\n", "\r", "\r\n", "\n \n", "\x00", "\x0c", "\x7f", "\xa0", " \n", "<!--", "-->", "<!-->", "--", "<!", "longer than others. "]


def texts(n=300):
    rng = random.Random(11)
    out = ["", " ", "\n", "\r", "<!-- a", "--><!--", "<!--a--> b <!-- c", " \x00 a \x00 ", "\x00" * 9, "\xa0", "a\r\x00\n\r\nb"]
    for _ in range(n):
        some = rng.sample(PIECES, rng.randint(1, len(PIECES)))
        out.append("".join(rng.choice(some) for _ in range(rng.randint(0, 120))))
    return out


def test_cleaning_by_parts(spark):
    rng, given = random.Random(3), texts()
    df = spark.createDataFrame(list(enumerate(given)), "id int, t string")
    rows = df.select("id", X.clean_text(F.col("t")).alias("text"), X.clean_markdown(X.clean_text(F.col("t"))).alias("markdown"), X.clean_document(F.col("t")).alias("document")).collect()
    for r in rows:
        again = lambda: parted(given[r.id], rng)
        assert "".join(S.clean_text(again())) == r.text
        assert "".join(S.clean_document(again())) == r.document
        parts = again()
        assert "".join(S.clean_markdown(lambda: iter(parts))) == r.markdown


def test_chunks_by_parts():
    rng, how = random.Random(5), set()
    for t in ("".join(S.clean_text([t])) for t in texts(600)):
        for size, overlap in ((1, 0), (8, 3), (20, 0), (20, 19), (60, 15), (10_000, 200)):
            parts = parted(t, rng)
            got = list(S.semantic_chunks(lambda: iter(parts), len(t), size, overlap))
            assert got == X.semantic_chunks(t, size, overlap), (t, size, overlap)
            fits = lambda cut: all(len(u) <= size for u in cut.split(t))
            how.add("whole" if len(t) <= size else "paragraphs" if fits(S.PARAGRAPH) else "sentences" if fits(S.SENTENCE) else "windows")
    assert how == {"whole", "paragraphs", "sentences", "windows"}


LONG = {
    "sentences": "Some words here. " * 150_000, "words": "word " * 500_000, "paragraphs": "A paragraph.\n\n" * 180_000, "blank lines": " \n" * 1_200_000 + "x",
    "blanks": "a" + " " * 2_500_000 + "b", "comments begun": "<!-- " * 500_000, "carriage returns": "\r\n" * 1_200_000,
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_what_is_held_does_not_grow(name, monkeypatch):
    monkeypatch.setattr(S, "STEP", 1 << 14)
    text = LONG[name]
    data = text.encode()
    tracemalloc.start()
    rows = sum(1 for _ in processing.chunk_rows(lambda: S.clean_markdown(lambda: S.decoded(io.BytesIO(data))), "md"))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and held < 400_000 < len(data) / 5


def docx(*body):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(body)}</w:body></w:document>')
    return data.getvalue()


def test_paragraphs_of_documents():
    p = lambda inner: f"<w:p><w:r>{inner}</w:r></w:p>"
    t = lambda x: f"<w:t>{x}</w:t>"
    table = f"<w:tbl><w:tr><w:tc>{p(t('cell'))}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl>"
    box = p(t("outer") + f"<w:box>{p(t('in') + '<w:tab/>')}{p(t('side'))}</w:box>" + "<w:br/>" + t("end"))
    assert files.docx_text(docx(p(t("one")), table, box, p(t("last")))) == "one\ncell\n\nouterin\tside\nend\nin\t\nside\nlast"
    assert files.docx_text(docx()) == ""


def test_files_are_never_a_row(spark, tmp_path):
    """Spark's reader of whole files refuses these; names with blanks and signs are opened as they are."""
    at = tmp_path / "in" / "a b"
    at.mkdir(parents=True)
    long = "".join(f"Sentence {i} of it. " for i in range(3000))
    (at / "long %20#?.txt").write_text(long)
    (at / "é.md").write_text("<!-- gone -->" + long)
    (at / "d.docx").write_bytes(docx("".join(f"<w:p><w:r><w:t>{i}</w:t></w:r></w:p>" for i in range(900))))
    store = processing.FileStore(spark, f"file://{tmp_path}/store", lambda df, c: embed_distinct(df, c, HashEmbedder(8)), buckets=2)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")
    try:
        assert {(r.name, r.status) for r in store.process(f"file://{tmp_path}/in").collect()} == {(f"a b/{n}", "done") for n in ("long %20#?.txt", "é.md", "d.docx")}
        assert {r.status for r in store.process(f"file://{tmp_path}/in").collect()} == {"skipped"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r.name: (r.hash, r.text_length) for r in store.ledger().where("name like '%.txt'").collect()} == {"a b/long %20#?.txt": (hashlib.sha256(long.encode()).hexdigest(), len(long.strip(" ")))}
    got = [(r.content, r.start_position, r.end_position) for r in store.chunks().where("name like '%.txt'").orderBy("chunk_index").collect()]
    assert [c for c, _, _ in got] == X.semantic_chunks(long.strip(" "), *X.CHUNK_SIZES["txt"])
    assert [s for _, s, _ in got] == [0, *[e for _, _, e in got[:-1]]]


def test_file_rows_travel(tmp_path):
    (tmp_path / "a.md").write_text("some text")
    (tmp_path / "f").write_bytes(cloudpickle.dumps(lambda at: list(processing.file_rows(*processing.opened(f"file:{at}"), "a.md"))))
    code = "import sys; from pyspark import cloudpickle; print(cloudpickle.load(open('f', 'rb'))(sys.argv[1])); assert 'graphquarry' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and "some text" in done.stdout, done.stderr


def test_vectors_find_their_texts(spark):
    """Repeated, empty and null texts each get the vector of their text."""
    df = spark.createDataFrame([(0, "a b"), (1, None), (2, ""), (3, "a b"), (4, "c")], "id int, text string")
    got = {r.id: r.embedding for r in embed_distinct(df, "text", HashEmbedder(8)).collect()}
    want = {r.id: r.embedding for r in HashEmbedder(8).embed(df, "text").collect()}
    assert got == want and len(got) == 5 and embed_distinct(df, "text", HashEmbedder(8)).columns == ["id", "text", "embedding"]
