import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import bench


@pytest.mark.parametrize("full", [False, True])
def test_clauses_of_one_chunk_by_brute_force(spark, monkeypatch, full):
    """Few letters, so that clauses share their beginnings and lie inside others, characters beyond 16 bits, bodies of several slices, a bitmap that lets nearly all pass; each run that passes is a clause's, and no clause meets the bodies that share a term with it only."""
    if full:
        monkeypatch.setattr(bench, "GATE_BITS", 12)
    monkeypatch.setattr(bench, "SLICE_CHARS", 300)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("一丁"), size=rng.integers(6, 13))) + str(rng.choice(["", "", "é", "𠀀x"]))
    bodies = ["，".join(word() for _ in range(rng.integers(1, 5))) for _ in range(150)] + ["", "，"]
    rows = [(i, f"d{i // 6}", i % 6, b) for i, b in enumerate(bodies)] + [(200, "n", 0, None)]
    chunks = spark.createDataFrame(rows, "row_id long, document_key string, chunk_index int, body string").repartition(3)
    clauses = {(r["document_key"], r["chunk_index"]): r["c"] for r in chunks.select("document_key", "chunk_index", bench.clause_of(F.col("body")).alias("c")).where("c is not null").collect()}
    want, taken = set(), {}
    for (doc, at), c in sorted(clauses.items()):
        if sum(c in b for b in bodies) == 1 and taken.setdefault(doc, 0) < 4:
            taken[doc] += 1
            want.add((doc, at, c))
    assert len(want) > 20
    made = []
    keep = bench._held_clauses
    monkeypatch.setattr(bench, "_held_clauses", lambda *a: made.append(keep(*a)) or made[-1])
    assert {tuple(r) for r in bench.verbatim_questions(chunks, chunks).collect()} == want
    if not full:
        listed = set(clauses.values())
        held = [(r["clause"], r["row_id"]) for r in made[0].collect()]
        assert {(c, i) for c, i in held if c in listed} == {(c, i) for c in listed for i, b in enumerate(bodies) if c in b}
        assert sum(c not in listed for c, _ in held) <= 5
