"""Operators on inputs of a size at which their cost shows, against plain loops."""

import time


from pyspark.sql import functions as F

from vellum.operators import control, layout, pages, reports, structure, textlayer
from vellum.plans import registry, text_queries


def test_ink_lines_of_a_large_image(spark):
    """One image of 40,000 components; a fold that copies its bands for each takes minutes."""
    parts = [(1, i, (i * 37) % 9000, (i % 40) * 14 + i % 3, 4, 8 + i % 3, 5, 9) for i in range(40_000)]
    live, members = [], {}
    for _, at, x, y, _, height, _, _ in sorted(parts, key=lambda p: (p[3], p[1])):
        bottom = y + height - 1
        for band in live:
            over = min(bottom, band[2]) - max(y, band[1]) + 1
            if over > 0 and over >= 0.5 * min(height, band[2] - band[1] + 1):
                break
        else:
            band = [len(live), y, bottom]
            live.append(band)
        band[1:] = y, bottom
        members[band[0]] = members.get(band[0], 0) + 1
    start = time.time()
    got = control.ink_lines(spark.createDataFrame(parts, "img long, at long, x long, y long, width long, height long, area long, glyph long"), gap=1e9).collect()
    assert time.time() - start < 100
    assert sorted(r["members"] for r in got) == sorted(members.values()) and len(got) >= 20


def test_medians_are_the_upper_ones(spark):
    """Of an even number of values the upper middle one; missing ones do not count, another image's neither."""
    cells = [(1, 4, 1), (1, 4, 2), (1, 8, 2), (1, 8, None), (2, 6, 3), (2, None, 3), (2, 7, 9)]
    parts = spark.createDataFrame([(i, 1, 1, 1, h, 9, r) for i, h, r in cells], "img long, at long, x long, y long, height long, area long, run long")
    assert sorted((r["img"], r["height"], r["glyph"]) for r in control.text_like(parts).collect()) == [(1, 4, 8), (1, 4, 8), (1, 8, 8), (2, 6, 7)]


def test_unique_names_of_a_large_folder(spark):
    """20,000 files of one folder whose names clash, numbered ones with those of other bases too."""
    bases = [("A", "a", "a 2", "A 2 3", "b 4", "a 10", "a 02", "ΟΔΟΣ", "οδοσ")[i * i % 9 if i % 5 else 0] for i in range(20_000)]
    there = ["a 3 ocr.pdf", "A OCR.PDF", "b 5 ocr.pdf"]
    files = [(1, i, b, there[i] if i < 3 else f"{b}.pdf") for i, b in enumerate(bases)]
    taken, following, want = {n.lower() for n in there}, {}, []
    for b in bases:
        name, n = f"{b} ocr.pdf", following.get(b.lower(), 2)
        while name.lower() in taken:
            name, n = f"{b} {n} ocr.pdf", n + 1
            following[b.lower()] = n
        taken.add(name.lower())
        want.append(name)
    start = time.time()
    got = reports.unique_names(spark.createDataFrame(files, "folder long, at long, base string, file string"), " ocr", "pdf").orderBy("at").collect()
    assert time.time() - start < 60
    assert [r["name"] for r in got] == want


def test_columns_of_pages_are_spread_by_the_size_of_the_documents(spark, tmp_path):
    """The pages alone are a small shuffle, which AQE joins to few partitions; each page then becomes a hundred rows."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat(cast(rand(1) as string), 4) as text", "'en' as lang", "'s' as source", "72L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = text_queries.ink_columns(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) == 4 and max(r["count"] for r in rows) < 100_000
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert registry.pieces(d) == 4 and registry.pieces(d, 1 << 10) > 40 and registry.pieces(d, most_rows=100) == 30


def test_closure_of_many_paths(spark):
    """40 nodes of which each refers to the next two stand on some 10**8 paths."""
    steps = [(i, i + k) for i in range(39) for k in (1, 2) if i + k < 40]
    edges = spark.createDataFrame([*steps, (39, 0), (3, None)], "from_node long, to_node long")
    got = sorted(tuple(r) for r in structure.closure(edges, spark.createDataFrame([(0,), (30,)], "node long")).collect())
    assert got == [(r, i) for r in (0, 30) for i in range(40)]


def test_copies_over_many_paths_are_numbered_without_gaps(spark):
    """Pages and what only they lead to stay out, whatever the number of paths."""
    steps = [(i, i + k) for i in range(39) for k in (1, 2) if i + k < 40]
    edges = spark.createDataFrame([*steps, (5, 100), (100, 101)], "from_node long, to_node long")
    got = structure.copied_ids(edges, spark.createDataFrame([(0,)], "node long"), spark.createDataFrame([(100,)], "node long"), 7).orderBy("node").collect()
    assert [tuple(r) for r in got] == [(0, i, 7 + i) for i in range(40)]


def test_retention_moves_texts_and_not_their_words(spark):
    """Rows of a document count together, and words one by one never travel."""
    schema = "doc long, text string"
    truth = spark.createDataFrame([(1, "A b\u00a0c a"), (1, "a\tB"), (2, None), (3, " "), (4, "x"), (None, "y")], schema)
    got = textlayer.retention(truth, spark.createDataFrame([(1, "a a b"), (1, "B z"), (2, "q"), (None, "y")], schema))
    assert sorted((tuple(r) for r in got.collect()), key=str) == [(1, 3, 5), (4, 0, 1), (None, 0, 1)]
    assert "word" not in got._jdf.queryExecution().executedPlan().toString()


def test_helper_settings_are_parsed_once(spark):
    """The last value of a name counts; planning took more than a minute when each value was an expression of the whole list."""
    good = ["--fast", "1", "--language-correction", "0", "--languages", "en", "--custom-words", "", "--min-text-height-on", "0", "--min-text-height", "0.5", "--confidence", "0.25"]
    lists = [[*good, "--fast", "0"], [*good, "--odd"], [*good, "odd", "1"], good[2:], [*good, "--fast", "yes"], [*good, "--more", None], [*good, None, "1"], [], None]
    start = time.time()
    got = spark.createDataFrame([(i, a) for i, a in enumerate(lists)], "i int, a array<string>").select("i", pages.helper_settings(F.col("a")).alias("s")).select("i", "s", "s.fast", "s.confidence").orderBy("i").collect()
    assert time.time() - start < 30
    assert [r["i"] for r in got if r["s"] is not None] == [0, 5] and got[0]["fast"] is False and got[5]["fast"] is True
    assert tuple(got[0]["s"]) == (False, False, "en", "", False, 0.5, 0.25)


def test_values_without_reference_do_not_meet_in_the_join(spark):
    """They have no key, so all of them would be in one partition."""
    rows = spark.range(0, 4000).selectExpr("id", "if(id % 4 = 0, id || ' 0 R', 'plain ' || id) as value")
    got = structure.resolved(rows, spark.range(0, 3000).selectExpr("id as object", "'of ' || id as content").hint("merge"))
    want = {i: f"plain {i}" if i % 4 else f"of {i}" if i < 3000 else None for i in range(4000)}
    assert {r["id"]: r["value"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "isnotnull" in plan[plan.index("Join LeftOuter"):]


def test_neighbours_are_found_without_joining_lines(spark):
    """The same as headroom() and right_limit(), where lines share a place too; the lines are read once."""
    cells = [(d, 1, i % 17, ((i * 29) % 90) / 100, (i // 3) * 0.05 + (i % 3) * 0.004, 0.35, 0.02 + (i % 2) * 0.015, f"t {i}") for d in (1, 2, None) for i in range(17 if d == 1 else 20)]
    lines = spark.createDataFrame(cells, "doc long, page long, pos long, x double, y double, width double, height double, text string")
    keys = ["doc", "page", "pos"]
    want = lines.join(layout.headroom(lines), keys, "left").join(layout.right_limit(lines), keys, "left").select(*keys, "text", "room", "limit")
    got = textlayer.neighbours(lines).select(*keys, "text", "room", "limit")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "Join" not in textlayer.placement(lines)._jdf.queryExecution().executedPlan().toString()


def test_anchor_is_the_longest_word_that_stands_once(spark):
    """Words that stand twice are passed over; without any other there is no anchor."""
    page = "lengthiest lengthiest unique1 other common common"
    df = spark.createDataFrame([("common other lengthiest unique1", page), ("common lengthiest", page), ("a b", page)], "text string, page string")
    assert [r[0] for r in df.select(textlayer.anchor(F.col("text"), F.col("page"))).collect()] == ["unique1", None, None]
