from graphquarry import catalog
from graphquarry.operators import ingest


def test_status_of_every_row(spark):
    nodes = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    points = spark.createDataFrame([(2,), (3,), (None,)], "id long")
    status = ingest.ingest_status(nodes, points, "id")
    assert sorted(map(tuple, status.select("in_graph", "in_vectors").collect())) == [(False, False)] * 2 + [(False, True), (True, False), (True, True), (True, True)]
    s = ingest.ingest_summary(status).first()
    assert (s.total, s.succeeded, s.partially_succeeded, s.failed) == (6, 2, 2, 2)


def test_the_summary_reads_both_tables(spark, small):
    s = catalog.QUERIES["ingest_summary"](spark, small).first()
    n_documents, n_vectors = (spark.read.parquet(f"{small}/{t}.parquet").count() for t in ("documents", "embeddings"))
    assert max(n_documents, n_vectors) <= s.total <= n_documents + n_vectors and s.total == s.succeeded + s.partially_succeeded + s.failed
