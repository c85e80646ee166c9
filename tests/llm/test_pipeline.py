"""Every stage of the corpus pipeline on small tables, against plain Python."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from vellum.llm import lines, mixing, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BIG = 2**53 + 1


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{'red green blue gold grey teal'.split()[i]}{j}" for i, j in zip(rng.integers(0, 6, n), rng.integers(0, 90, n), strict=True))


@pytest.fixture(scope="module")
def rows():
    shared = "This very line stands in many documents of the corpus"
    out = [(i, f"{prose(i, 30)}\n{shared}\n{prose(500 + i, 12)}{' vile scum' if i % 4 == 0 else ' kind'}", "en", "abc"[i % 3]) for i in range(120)]
    near = out[1][1].split("\n")[0].split()
    out += [(BIG, out[1][1], "en", "a"), (None, " ".join(near[:14] + ["other"] + near[15:]), "en", None), (-1, prose(900, 50), None, None), (None, None, "en", "a"), (None, "", "en", "b"), (-1, prose(901, 50), "de", "b")]
    return [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in out]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held(df):
    assert df.columns == COLUMNS
    return [tuple(r) for r in df.collect()]


def test_toxicity_stage(spark, docs, rows, sf_dir):
    got = Counter(held(corpus_pipeline.drop_toxic(spark, docs, sf_dir)))
    assert got == Counter(r for r in rows if not (r[1] and "vile scum" in r[1]))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_line_stage(spark):
    base = "A line that is long enough to be compared"
    variants = [base, base + "!", base.replace("long", "lng"), base.replace("line", "lime") + "?", base.upper(), "short", "short"]
    texts = [(1, "\n".join(variants[:2])), (None, f"{variants[2]}\nshort"), (2, f"{variants[4]}\n{variants[3]}\n\nshort"), (2, base), (2, base), (BIG, f"x\n{variants[4]}x"), (3, None), (4, "")]
    d = spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    hashes = {t: h for t, h in d.selectExpr("text", "xxhash64(text)").collect()}
    # earlier: null ids first, then by id, hash of the text and line; rows alike in id and text are one document
    at = {}
    for i, t in set(texts):
        for k, s in enumerate(t.split("\n") if t is not None else []):
            if len(s) >= lines.MIN_CHARS:
                at.setdefault(s, []).append(((i is not None, i or 0), hashes[t], k))
    want = []
    for i, t in texts:
        kept = []
        for k, s in enumerate(t.split("\n") if t is not None else []):
            me = ((i is not None, i or 0), hashes[t], k)
            gone = len(s) >= lines.MIN_CHARS and (min(at[s]) < me or any(min(p) < min(at[s]) and edits(s, o) <= lines.TAU for o, p in at.items()))
            if not gone:
                kept.append(s)
        want.append((i, None if t is None else "\n".join(kept)))
    got = held(corpus_pipeline.dedup_lines(spark, d, ""))
    assert Counter((r[0], r[1]) for r in got) == Counter(want)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in got)


def test_group_stage(spark, docs, rows):
    got = Counter(held(corpus_pipeline.keep_one_of_each_group(spark, docs, "")))
    table = [set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) if t else set() for _, t, *_ in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(table):
        for j, b in enumerate(table[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = (min(k for k in range(len(rows)) if root[k] == root[m]) for m in (i, j))
                old, new = root[max(x, y)], root[min(x, y)]
                root = [new if r == old else r for r in root]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(rows[k])
    assert sum(got.values()) == len(groups) < len(rows)
    for members in groups.values():
        ids = [m[0] for m in members if m[0] is not None]
        assert sum(got[m] for m in members) == 1
        assert not ids or any(got[m] for m in members if m[0] == min(ids))


def test_mixing_stage(spark, docs, rows):
    got = held(corpus_pipeline.mix(spark, docs, ""))
    size = Counter()
    taken = Counter()
    texts = {(r[0], r[2], r[3]): r[1] or "" for r in rows if r[0] != -1}
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    for r in got:
        taken[r[3]] += len(r[1].split())
        assert r[4] == len(r[1]) and (r[0] in (-1, None) or r[1] in texts[r[0], r[2], r[3]])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([size[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2.0)
    assert all(abs(taken[s] - t) <= mixing.BLOCK_WORDS for s, t in zip(order, targets, strict=True))


def test_packing_stage(spark, docs, rows):
    tok = packing.ChunkTokenizer.of(packing.default_tokenizer(), 1).tokenizer
    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    ids, got = [], Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["length"] <= 2048 and p["start"] == len(ids)
        ids += np.frombuffer(p["ids"], "<u4").tolist()
        if len(ids) == p["doc_tokens"]:
            got[p["doc_id"], tuple(ids)] += 1
            ids = []
    assert got == want


def test_odd_texts_are_tokenised_as_by_the_tokenizer():
    tok = packing.ChunkTokenizer.of(packing.default_tokenizer(), 1)
    texts = ["", " ", "Ünïcode ſtraße İstanbul", "日本語 テキスト", "tabs\there\x0bthere", "é é", "​zero", "a.,b..,", "ß ẞ ǅ", "퟿", "emoji 😀😀", "x" * 3000, " nbsp em", "MiXeD Case."]
    import pyarrow as pa

    ids, ends, _ = tok.encode(pa.array(texts))
    assert [p.tolist() for p in np.split(ids, ends[:-1])] == [[*tok.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_the_whole_run(spark, sf_dir, rows):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert pieces and {p["doc_id"] for p in pieces} <= {r[0] for r in rows}
    assert not {p["doc_id"] for p in pieces if p["doc_id"] is not None and 0 <= p["doc_id"] < 120 and p["doc_id"] % 4 == 0}
    assert BIG not in {p["doc_id"] for p in pieces}  # a copy of document 1
