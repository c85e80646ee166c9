"""Substring dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np

from vellum.llm import repeats

SF = "/root/testdata/sf0.001"


def brute(rows, window=35):
    """(doc_id, n_words, n_removed, sha256) of each (doc_id, text)."""
    words = [t.encode().split() if t else [] for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in repeats.op10_repeats(spark, SF).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert sum(r[2] for r in got)


def test_odd_ids_and_passages(spark):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5000, n))
    passage, long = text(80), text(3000)
    rows = [(2**53 + 1, passage), (-1, f"{text(50)} {passage}"), (None, f"{text(40)} {passage} {text(60)}"), (None, text(90)), (None, None), (7, ""), (7, passage[:200])]
    rows += [(8, long), (8, f"{long} {long}"), (9, f"{passage} {text(10)} {passage}"), (10, " ".join(["same"] * 200)), (11, "é ü x " * 50)]
    rows += [(100 + i, f"{text(20)} {' '.join(passage.split()[i % 20 :])} {text(i)}") for i in range(60)] + [(-1, f"{text(50)} {passage}")]
    rows.append(rows[3])  # a repeated row without an id
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, run long")
    got = [tuple(r) for r in repeats.without_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert repeats.without_repeats(df.limit(0)).count() == 0
