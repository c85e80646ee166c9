"""Training-data operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import common, jaccard, language, lines, mixing, neighbours, packing, quality, repeats, shards, toxicity

WORDS = "red green blue cyan pink gold grey teal lime plum rust sand navy jade coal mint ruby opal onyx iris".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 50, n), strict=True))


BASE = text(1, 60)
NEAR = BASE.replace(BASE.split()[30], "changed", 1)
LONG = text(2, 3000)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, NEAR, "en", "b"), (4, None, None, None), (5, "", "en", None),
    (6, " \n\t ", "de", "b"), (7, "two words", "en", "a"), (8, LONG, "en", "a"), (9, LONG + " " + text(3, 500), "de", "b"),
    (10, text(4, 40) + "\n" + BASE, "en", "c"), (10, text(4, 40) + "\n" + BASE, "en", "c"), (None, text(5, 50), "en", "a"),
    (11, "x.\nA line that is long enough to count.\nA line that is long enough to count!\nshort\nshort", "en", "a"),
    (12, "\n".join(["A line that is long enough to count."] * 3), "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, la, s, None if t is None else len(t), 7, 8) for i, t, la, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node long, start long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(t):
    return t.encode().split() if t else []


def test_mixing(docs, none):
    out = mixing.mix_sources(docs, block_words=16).groupBy("doc_id", "source", "row_hash", "size", "source_size", "target", "start").agg(F.sum("n_words").alias("taken")).collect()
    assert len(out) == len(ROWS)
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    per = Counter()
    for r in out:
        per[r["source"]] += r["taken"]
    for r in out:
        assert abs(per[r["source"]] - r["target"]) <= 40
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(per.values())
    assert mixing.mix_sources(none).count() == 0


def test_mixed_documents_keep_whole_numbers_and_reruns_agree(spark):
    rows = [(2**53 + 1, text(1, 40), "a", 2**60 + 1), (None, text(2, 50), "b", None), (-1, text(3, 30), None, 5), (None, text(4, 20), "b", 2**53 + 3), (7, None, "a", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    got = [tuple(r) for r in mixing.mixed_documents(d, block_words=8).collect()]
    by = {(t, i, s, x) for i, t, s, x in rows}
    assert got and all(any(r[1] in (t or "") and (r[0], r[2], r[3]) == (i, s, x) for t, i, s, x in by) for r in got)
    assert sorted(got, key=repr) == sorted((tuple(r) for r in mixing.mixed_documents(d, block_words=8).collect()), key=repr)


def test_deal_of_large_numbers():
    rng = np.random.default_rng(1)
    here = np.array([3 * 10**9, 10**9, 5 * 10**8], np.int64)
    got = np.array([mixing._deal(rng, here, 10**6) for _ in range(50)])
    assert (got.sum(axis=1) == 10**6).all() and len({tuple(x) for x in got}) > 40
    assert np.abs(got.mean(axis=0) / 10**6 - here / here.sum()).max() < 1e-3
    assert (mixing._deal(rng, here, int(here.sum())) == here).all()


def test_water_fill():
    assert mixing.water_fill([10, 100], [5, 2], 60, 2) == [20, 40]


def test_permutation():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing._permute(np.arange(n), n, 5).tolist()) == list(range(n))


def test_packing(docs, none):
    tok = packing.ChunkTokenizer.of(packing.default_tokenizer(), 1)
    got = packing.pack(docs, sequence=64, stride=16).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in pieces:
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= 64
    whole = Counter(tuple([*tok.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _, _ in ROWS)
    found, current = Counter(), []
    for pieces in by.values():
        for r in pieces:
            current += np.frombuffer(r["ids"], "<u4").tolist()
            if r["start"] + r["length"] == r["doc_tokens"]:
                found[tuple(current)] += 1
                current = []
    assert found == whole
    assert packing.pack(none).count() == 0


def test_best_cuts_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pos = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 12))))
        pen = np.round(rng.random(13) * 4, 2)
        cost = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        f = [0.0] + [1e9] * 12
        for j in range(1, 13):
            f[j] = min(f[i] + cost(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= 16) + pen[j]
        cuts = packing.best_cuts(pos, pen, 16)
        at = dict(zip(pos.tolist(), pen.tolist(), strict=True))
        assert abs(sum(cost(b - a) + at[b] for a, b in zip([0, *cuts], cuts, strict=False)) - f[12]) < 1e-6


def test_quality(docs, none):
    got = quality.quality_verdicts(docs).collect()
    want = []
    for _, t, _, _ in ROWS:
        w = words(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        ls = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        want.append((len(w), len(cover), len(ls) - len(set(ls))))
    assert sorted((r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) for r in got) == sorted(want)
    assert quality.quality_verdicts(none).count() == 0


def test_toxicity(spark, docs, none):
    rows = [(i, f"{text(100 + i, 30)} {'vile scum' if i % 3 == 0 else 'kind'} {text(300 + i, 5)}") for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)] + [(999, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.toxicity(d, labels).collect()}
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in got.items())
    assert all(0 <= r["toxic_score"] <= 1 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.toxicity(none, labels).count() == 0


def test_toxicity_keeps_every_word_and_pair(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK_TOKENS", 50)  # many chunks and buckets give the same sums
    texts = [f"{'foul' if i % 2 else 'nice'} thing{i} rare{i // 40} pair{i // 40}" for i in range(80)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    folds = {r[0]: r[1] for r in d.select("doc_id", common.fold_of("doc_id", 5)).collect()}
    kinds = d.join(labels, "doc_id").select(F.xxhash64("text").alias("_h"), "text", F.when(common.fold_of("doc_id", 5).between(1, 3), F.col("toxic")).otherwise(2).alias("toxic"))
    tokens = common.saved(toxicity._chunks(kinds), "tokens")
    assert tokens.count() > 4
    known = spark.sparkContext.broadcast(toxicity._known_pairs(tokens, 320))
    pairs = common.saved(toxicity._pair_sums(toxicity._requests(tokens, True, 64, known), 64), "pairs")
    asked = [x for r in toxicity._requests(tokens, True, 64, known).collect() for x in toxicity._unpack_sorted(bytes(r["keys"])).tolist()]
    every = [x for r in toxicity._requests(tokens, True, 64).collect() for x in toxicity._unpack_sorted(bytes(r["keys"])).tolist()]
    assert len(asked) < len(every) and set(asked) <= set(every)
    sums = toxicity._word_sums(toxicity._requests(tokens, False, 64).union(pairs.where("chunk < 0"))).collect()
    got = {}
    for row in tokens.collect():
        words = toxicity._unpack_sorted(bytes(row["vocabulary"]))
        mine = sorted((r for r in sums if r["chunk"] == row["chunk"]), key=lambda r: r["bucket"])
        got |= dict(zip(words.tolist(), zip(*[np.concatenate([toxicity._unpack(bytes(r[c]), np.int32) for r in mine]).tolist() for c in "abcdefg"], strict=True), strict=True))
    want, after = {}, {}
    for i, x in enumerate(texts):
        kind, w = (1 - i % 2 if 1 <= folds[i] <= 3 else 2), x.split()
        for a in set(w):
            want.setdefault(a, [0] * 3)[kind] += 1
        for a, b in set(zip(w, w[1:], strict=False)) if kind < 2 else ():
            after.setdefault(a, ([], []))[kind].append(b)
    for a, n in want.items():
        t, o = after.get(a, ([], []))
        assert got[int(common.word_hashes([a.encode()])[0])] == (*n, len(t), len(o), len(set(t)), len(set(o)))
    # a word of one labelled document and a pair of one have a say, if a small one
    t, o = np.array([0, 1, 40]), np.array([0, 0, 0])
    totals = np.array([1000, 10_000, 500, 2000, 50_000, 5000])
    ratio = toxicity.word_ratios([t, o], toxicity.word_chances([t, o, o], totals), totals)
    assert ratio[0] == 0 < ratio[1] < ratio[2]
    pair = toxicity.pair_ratios([t, o], [np.full(3, 50), np.full(3, 500), np.full(3, 20), np.full(3, 100)], [np.full(3, 1e-4)] * 2, np.zeros(3))
    assert pair[0] == 0 < pair[1] < pair[2]


def test_language_keeps_ids_and_narrows_by_script(spark):
    train = spark.createDataFrame([("en", "the cat sat on the mat and then it ran away " * 5), ("ru", "кошка сидела на коврике и потом убежала " * 5)], "lang string, text string")
    rows = [(2**53 + 1, "the mat"), (None, "кошка"), (None, None), (-1, "12 34"), (3, "the cat " + "ж" * 60 + " sat on the mat"), (2**53 + 1, "the mat")]
    d = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = language.language_spans(d, train).collect()
    assert Counter((r[0], r[1]) for r in got) == Counter([(2**53 + 1, "en"), (None, "ru"), (None, "und"), (-1, "und"), (3, "ru"), (2**53 + 1, "en")])
    assert [s["lang"] for r in got if r[0] == 3 for s in r["spans"]] == ["en", "ru", "en"]


def test_language(spark, none):
    en, de = "the house and this thing with other words that they have", "der hund und die katze nicht eine auch werden schön"
    train = spark.createDataFrame([(1, en, "en"), (2, de, "de"), (3, None, "de"), (4, "привет мир", "ru")], "doc_id long, text string, lang string")
    d = spark.createDataFrame([(1, f"{en} {en} {de}"), (2, None), (3, "1 2 3 !"), (4, "мир"), (5, de)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.language_spans(d, train, switch=4.0).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "und", "und", "ru", "de"]
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"]
    assert language.language_spans(none, train).count() == 0


def test_language_keeps_rare_languages(spark):
    big = [(i, " ".join(f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in WORDS[i % 20 : i % 20 + 3]), "aa") for i in range(30)]
    rare = [(100, "qwxyz zyxwq", "yy"), (101, "jjkkvv vvkkjj", "zz")]
    schema = "doc_id long, text string, lang string"
    train = spark.createDataFrame(big + rare, schema)
    d = spark.createDataFrame([*big[:3], *rare, (102, None, None), (102, "", None), (103, "1 2", None), (None, "zyxwq", None)], schema)
    rows = lambda **x: sorted(map(str, language.language_spans(d, train, **x).collect()))
    joined = rows(max_grams=20)
    assert joined == rows() == rows(max_languages=2)
    got = {r["doc_id"]: r["lang_pred"] for r in language.language_spans(d, train, max_grams=20).collect()}
    assert (got[0], got[100], got[101], got[103], got[None]) == ("aa", "yy", "zz", "und", "yy")


def test_language_takes_many_languages(spark):
    train = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x", f"l{i:03}") for i in range(520)], "doc_id long, text string, lang string")
    got = language.language_spans(train.limit(5), train).collect()
    assert sorted(r["lang_pred"] for r in got) == [r[0] for r in train.limit(5).select("lang").collect()]


def test_viterbi_is_best():
    rng = np.random.default_rng(3)
    for s in (rng.normal(size=(n, 3)) * 3 for n in (1, 2, 6)):
        import itertools

        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=len(s)), key=value)
        assert abs(value(language.viterbi([s], 2.0)[0].tolist()) - value(best)) < 1e-9


def test_shards(spark, docs, none, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), min_bytes=100_000, target_bytes=1_000_000)
    key = F.coalesce("doc_id", F.lit(0))
    for i in range(5):
        store.append(docs.where(F.pmod(key, F.lit(5)) == i).coalesce(1))
    before = store.manifest()
    assert len(before["shards"]) == 5
    store.compact()
    assert len(store.manifest()["shards"]) == 1 and store.vacuum() == 0
    assert store.read().exceptAll(docs).isEmpty() and docs.exceptAll(store.read()).isEmpty()
    # old versions stay readable, until they are vacuumed
    assert store.read(1).count() == before["shards"][0]["rows"] and store.read(5).exceptAll(docs).isEmpty()
    with pytest.raises(shards.CommitConflict):
        store.commit(before, [], None, "late")
    # what another writer has written and not yet named stays
    docs.coalesce(1).write.parquet(str(tmp_path / "s" / "data" / "unnamed"))
    assert store.vacuum(keep_versions=1) == 0 and store.versions() == [6]
    with pytest.raises(LookupError):
        store.read(1)
    assert store.vacuum(keep_versions=1, least_age_s=-60.0) >= 6 and store.read().count() == docs.count()
    assert shards.shard_documents(none).read().count() == 0


def test_shard_tiers():
    store = shards.ShardStore.__new__(shards.ShardStore)
    store.target, store.fan_in, store.least = 1000, 4, 10
    plan = lambda *sizes: [[s["bytes"] for s in run] for run in store.plan([{"bytes": n} for n in sizes])]
    assert plan(5, 5, 5) == [] and plan(5, 700, 5, 9, 10) == [[5, 5, 9, 10]]
    assert plan(*[50] * 5, 7, 7) == [[50] * 5] and plan(450, 450, 450) == [[450, 450]]
    assert plan(900, 800, 760) == []


def test_shards_of_rows_without_ids(spark):
    rows = [(None, "a"), (None, "a"), (3, None), (3, "b"), (-1, "c")]
    d = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, _file string, tier int")
    store = shards.shard_documents(d)
    assert sorted(map(repr, store.read().collect())) == sorted(map(repr, d.collect()))
    assert sum(s["rows"] for s in store.manifest()["shards"]) == len(rows)


def test_lines(docs, none):
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert got[11]["text"] == "x.\nA line that is long enough to count.\nshort\nshort"
    assert got[12]["text"] == "" and got[12]["_n_removed"] == 3
    assert got[1]["text"] == BASE and got[2]["text"] == "" and got[4]["text"] is None
    assert lines.dedup_lines(none).count() == 0


def test_jaccard(docs, none):
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert (got[1], got[2], got[3], got[4], got[5], got[8], got[9], got[10]) == (1, 1, 1, 4, 5, 8, 8, 10)
    assert jaccard.jaccard_components(none).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    other, third = text(71, 60), text(72, 60)
    rows = [(1, BASE), (5, NEAR), (5, other), (None, third), (None, third), (7, other + " x"), (None, BASE), (8, None), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r[0], r[1]) for r in corpus_pipeline.keep_one_of_each_group(spark, d, "").collect()]
    assert sorted(got, key=str) == sorted([(1, BASE), (5, other), (None, third), (8, None), (8, "")], key=str)


def test_orders_lose_no_link():
    rng = np.random.default_rng(5)
    rejected = 0
    for n in (1, 2, 30, 255, 256, 511, 3000, 9000):
        base = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        frequent = np.packbits(rng.random(1 << jaccard.SLOT_BITS) < 0.2)
        for share in (1.0, 0.9, 0.86, 0.8, 0.5, 0.0):
            a = np.unique(base)
            b = np.unique(np.concatenate([base[: int(n * share)], rng.integers(0, 1 << 64, n - int(n * share), dtype=np.uint64)]))
            ok = all(jaccard.under_orders(*(jaccard._parsed(jaccard.orders_of(x, frequent)) for x in (a, b))))
            assert ok or not jaccard.linked(a, b)
            rejected += not ok
    assert rejected > 5


def test_repeats(docs, none):
    got = sorted((r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.without_repeats(docs).collect())
    seen, want = Counter(), []
    for _, t, _, _ in ROWS:
        seen.update(tuple(words(t)[i : i + 35]) for i in range(len(words(t)) - 34))
    for _, t, _, _ in ROWS:
        w = words(t)
        cover = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        want.append((len(w), len(cover), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in cover)).hexdigest()))
    assert got == sorted(want)
    assert repeats.without_repeats(none).count() == 0


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 20)  # many tiles a list
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.12 for _ in range(4)] + [base[:5]])
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 0), (903, [1.0] * 16, None), (904, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = np.array([r[1] for r in rows[: len(x)]], np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    link = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    found = sum(min(got[i]["n_links"], int(link[i].sum())) for i in range(len(x)))
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x))) and found >= 0.9 * link.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 905))


def test_neighbours_of_several_dimensions(spark):
    rows = [(1, [1.0, 1.0], 0), (2, [1.0, 1.01], 0), (3, [1.0, 1.0], 1), (4, [1.0], 0), (5, [2.0], 0), (6, [1.0, 1.0, 1.0], 0), (7, [1.0, 1.0, 1.1], 0), (7, [1.0, 1.0, 1.1], 0), (8, [-1.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 6), (7, 2, 6), (7, 2, 6), (8, 0, 8)]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert neighbours.near_vectors(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14] + [(40, 40)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(spark, edges).collect()}
    assert got == {i: 0 if i < 15 else 15 for i in range(31)}
