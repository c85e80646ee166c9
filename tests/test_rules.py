"""Worked examples and refusals that the registered queries do not reach."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import scalars
from vellum.operators import corpus, imaging, pages, reports, structure, textlayer
from vellum.sources import tables
from vellum.streaming import landing

ROOT = Path(__file__).resolve().parent.parent


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_estimate_worked_example(spark):
    """Two of ten sampled pages of a document of 40, and one of a short one sampled whole."""
    sample = rows(spark, [("long", p) for p in range(10)] + [("short", p) for p in range(2)], "doc string, page int")
    census = rows(spark, [("long", 40), ("short", 2), ("other", 5)], "doc string, pages int")
    hits = rows(spark, [("long", 1, 300.0), ("long", 3, 200.0), ("short", 1, 100.0)], "doc string, page int, value double")
    r = corpus.stratified_estimate(hits, sample, census).first()
    assert (r["documents"], r["sampled_hits"], r["hits"], r["value"], r["exact_documents"], r["exact_hits"], r["exact_value"], r["whole_documents"]) == (2, 3, 9.0, 2100.0, 1, 1, 100.0, 1)
    assert (r["corpus_pages"], r["census_documents"], r["sample_pages"], r["pooled_hits"], r["sampled_value"], r["pooled_value"]) == (47, 3, 12, 11.75, 600.0, 2350.0)
    # scaled by the sample, not by the rows themselves
    assert corpus.stratified_estimate(hits.where("doc = 'long'"), sample, census).first()["hits"] == 8.0
    corpus.check_sample(hits, sample, census)
    for bad in (hits.withColumn("value", F.lit(None).cast("double")), hits.limit(0)):
        with pytest.raises(corpus.Refused):
            corpus.stratified_estimate(bad, sample, census)
    assert corpus.stratified_estimate(hits.limit(0), sample, census, allow_empty=True).first()["hits"] == 0
    for args in ((hits, sample.union(sample), census), (hits.withColumn("page", F.lit(99)), sample, census), (hits, sample, census.where("doc <> 'long'")), (hits, sample, census.withColumn("pages", F.lit(1)))):
        with pytest.raises(corpus.Refused):
            corpus.check_sample(*args)


def test_census_refusals(spark):
    for cells in ([("testdocs/a", "3"), ("a", "4")], [("a", "three")], [("a", None)]):
        with pytest.raises(corpus.Refused):
            corpus.read_census(rows(spark, cells, "path string, pages string"))


def test_conditions(spark):
    d = rows(spark, [("NaN",), ("5",), ("inf",), ("-",), (None,), ("4.9",)], "c string")
    assert sorted(r[0] for r in pages.where_all(d, ["c:ge:5"]).collect()) == ["5", "inf"]
    assert pages.where_all(d, ["c:ne:5"]).count() == 5
    with pytest.raises(ValueError):
        pages.parse_where("c:like:5")


def test_versions(spark):
    cases = [("1.2b", "1.1", True), ("1.10", "1.9", True), ("1.2", "1.2.0", False), ("v2", "1", True), ("", "0", False), ("1..5", "1.4", True)]
    got = rows(spark, cases, "a string, b string, want boolean").select(scalars.is_newer(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_tables_and_landing(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("# bar\n\na\tb\n1\t2\na\tb\n3\n# x\n4\t5\t6\n")
    assert [tuple(r) for r in tables.read_tsv(spark, str(path), ["a"]).collect()] == [("1", "2"), ("a", "b"), ("3", ""), ("4", "5")]
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(path), ["c"])
    (tmp_path / "in").mkdir()
    stream = lambda: landing.landed(spark, str(tmp_path / "in"), "doc long, page long, n_pages long")
    for k, records in enumerate(([(1, 1), (1, 2)], [(1, 2), (2, 1), (2, 1)])):
        (tmp_path / "in" / f"{k}.json").write_text("".join(f'{{"doc": {d}, "page": {p}, "n_pages": 2}}\n' for d, p in records))
        landing.publish(stream(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc"], r["page"]) for r in out.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert [r["doc"] for r in landing.complete_documents(out).collect()] == [1]
    assert spark.range(1).select(scalars.stamp(F.lit(86_399))).first()[0] == "1970-01-01 23.59.59"


def test_extracted_pages_refuse(spark):
    have = rows(spark, [(1, 1), (1, 2)], "doc int, page int")
    for wanted in ([(1, 1, 0), (1, 1, 1)], [(1, 3, 0)]):
        with pytest.raises(corpus.Refused):
            reports.extracted_pages(have, rows(spark, wanted, "doc int, page int, at int"))


def test_placement_refusals(spark):
    lines = rows(spark, [(1, 1, 0, 0.1, 0.1, 0.5, 0.02, ""), (1, 1, 1, 0.1, 0.3, 0.0001, 0.02, "a"), (1, 1, 2, 0.1, 0.5, 0.5, 0.02, "word")], "doc int, page int, pos int, x double, y double, width double, height double, text string")
    got = {r["pos"]: r for r in textlayer.placement(lines).collect()}
    assert got[0]["refused"] == "empty text" and got[1]["refused"] == "box too small" and got[2]["refused"] is None
    assert got[0]["size"] is None and got[2]["size"] > 0 and 0.25 <= got[2]["vertical"] <= 3


def test_continuation_over_the_page_break(spark):
    lines = [(1, 1, 0, 0.1, 0.8, 0.5, 0.02, "a bro-"), (1, 2, 0, 0.1, 0.05, 0.1, 0.02, "17"), (1, 2, 1, 0.1, 0.1, 0.5, 0.02, "Ken"), (1, 2, 2, 0.1, 0.2, 0.5, 0.02, "ken word"), (1, 3, 0, 0.1, 0.1, 0.5, 0.02, "3-")]
    got = {(r["page"], r["pos"]): r["text"] for r in textlayer.prepared(rows(spark, lines, "doc int, page int, pos int, x double, y double, width double, height double, text string")).collect()}
    assert got[1, 0] == "a broken" and got[2, 2] == "ken word" and got[3, 0] == "3-"


def test_outline_leaves_out_empty_nodes_and_stops_at_depth(spark):
    nodes = rows(spark, [("d", 1, None, 0, "a", None), ("d", 2, 1, 0, "b", 3), ("d", 3, None, 1, "c", None), ("d", 4, 2, 0, "e", 4)], "doc string, id long, parent long, at long, title string, page long")
    got = {r["title"]: (r["number"], r["level"], r["below"]) for r in structure.outline(nodes).collect()}
    assert got == {"a": (1, 1, 2), "b": (2, 2, 1), "e": (3, 3, 0)}
    assert structure.outline(nodes, depth=2).count() == 2


def test_components_against_a_flood(spark):
    rng = np.random.default_rng(2)
    for _ in range(40):
        mask = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < 0.4
        left, want = mask.copy(), []
        while left.any():
            todo, part = [tuple(np.argwhere(left)[0])], []
            left[todo[0]] = False
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                for a in range(max(y - 1, 0), min(y + 2, mask.shape[0])):
                    for b in range(max(x - 1, 0), min(x + 2, mask.shape[1])):
                        if left[a, b]:
                            left[a, b] = False
                            todo.append((a, b))
            y, x = np.array(part).T
            want.append((x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, len(part)))
        assert sorted(imaging.components(mask, 1)) == sorted(tuple(map(int, w)) for w in want)


def test_rasters_at_their_edges():
    empty = imaging.plane(b"", 4, 4)
    assert imaging.otsu(empty) == 186 and imaging.psnr(empty, empty) == -1.0
    g = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert math.isinf(imaging.psnr(g, g)) and imaging.downsampled(g, 9).shape == (1, 1) and imaging.downsampled(g, 2).shape == (2, 3)
    assert imaging.window_of(300, 1000, 800) == 75 and imaging.window_of(4, 1000, 800) == 3 and imaging.window_of(3000, 100, 80) == 40
    assert imaging.ink_outside(g, np.ones((2, 2), bool), 9) == 1.0 and imaging.correlation(np.ones(4), np.arange(4.0)) is None
    holes = np.zeros((9, 9), bool)
    holes[2:7, 2:7] = True
    out = imaging.filled(np.full((9, 9), 40, np.uint8), holes, 1)
    assert (out == 40).all()


def test_without_the_optional_parts(tmp_path):
    """The library works without the training-data subpackage and its tests."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') or k == 'pipeline' for k in q if k[2:3].isdigit() or k == 'pipeline'), sorted(q); assert e.oracle_sql()"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-1000:]
