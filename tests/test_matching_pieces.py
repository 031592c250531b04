"""Candidates and questions that meet in pieces, none of them through the driver."""

import numpy as np

from graphquarry.operators import semantic


def test_pieces_equal_one_piece(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, f"e{i % 7}", f"text {i}", [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    c = spark.createDataFrame([(e, i, t, v) for i, e, t, v in rows], "entity string, priority long, text string, embedding array<float>")
    q = spark.createDataFrame([(i, t.upper(), v) for i, _, t, v in rows if i % 10 == 0], "question_id long, question string, embedding array<float>")

    def no(*_):
        raise AssertionError("candidates went to the driver")

    monkeypatch.setattr(semantic, "blocks", no)
    x = np.array([r[3] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {(i, f"e{e}"): min(j for j in range(e, 300, 7) if j == i or x[i] @ x[j] >= 0.3) for i in range(0, 300, 10) for e in range(7) if any(j == i or x[i] @ x[j] >= 0.3 for j in range(e, 300, 7))}
    for sizes in ((20_000, 20_000), (7, 50)):
        monkeypatch.setattr(semantic, "QUESTION_PIECE", sizes[0])
        monkeypatch.setattr(semantic, "CANDIDATE_PIECE", sizes[1])
        got = {(r.question_id, r.entity): int(r.matched_text.split()[1]) for r in semantic.priority_match(q, c, 0.3, 16).collect()}
        assert got == want
        best = semantic.label_match(q, c, 0.3, 16).collect()
        assert {(r.question_id, r.entity, r.exact) for r in best} == {(i, f"e{i % 7}", True) for i in range(0, 300, 10)}
