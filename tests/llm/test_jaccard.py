"""N-gram Jaccard join against brute force."""

import numpy as np

from vellum.llm import jaccard

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id, n_shingles, component_id) of each (doc_id, text); a null id is the least of nothing."""
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = t.encode().translate(table).split() if t else []
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in jaccard.op9_jaccard(spark, SF).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_near_copies_of_many_kinds(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 3000, 120)]

    def edited(k):
        w = list(base)
        for i in rng.integers(0, len(w), k):
            w[i] = f"e{rng.integers(0, 10**6)}"
        return " ".join(w)

    rows = [(i, edited(i % 7)) for i in range(150)]
    rows += [(1000 + i, " ".join(base[: 60 + i] + [f"u{i}x{k}" for k in range(i)])) for i in range(0, 60, 3)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A b"), (None, " ".join(base)), (2**53 + 1, " ".join(base).upper()), (-1, "É é x y z"), (-2, "é É x y z"), (-2, "other words in here now"), (2004, " \n ")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, n long")
    counts: list = []
    got = [tuple(r) for r in jaccard.jaccard_components(df, counts).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert 1 <= len(counts) <= len(jaccard.PIVOTS) + 1 and all(a >= b >= c for a, b, c in counts) and counts[0][2]
