"""Intermediate tables that the Jaccard join leaves behind."""

from pathlib import Path

from vellum.llm import jaccard


def test_links_of_a_round_go_once_components_hold_them(spark):
    base = Path(spark.conf.get("spark.checkpoint.dir"))
    left = lambda: {p for name in ("links", "edges") for p in base.glob(f"**/{name}")}
    before = left()
    # each text lacks a word more than the one before, so that links run along chains of texts
    words = [f"w{k}" for k in range(60)]
    rows = [(100 * c + k, " ".join(f"{c}{w}" for w in words[k:])) for c in range(3) for k in range(12)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left() == before
    assert {(r["doc_id"], r["component_id"]) for r in out.collect()} == {(i, i // 100 * 100) for i, _ in rows}
