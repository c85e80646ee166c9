"""Shares of the toxicity operator's requests add up to all of them."""

import numpy as np

from vellum.llm import common, toxicity


def test_requests_in_shares_are_all_requests(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 200, 80)), i % 3) for i in range(40)]
    tokens = toxicity._chunks(spark.createDataFrame(rows, "_h long, text string, toxic int").coalesce(1), 40)
    assert len(tokens.collect()) == 1
    for pairs in (False, True):
        held = lambda df: sorted((r["bucket"], bytes(r["keys"]), bytes(r["a"]), bytes(r["b"]), bytes(r["c"])) for r in df.select("bucket", "keys", *toxicity._COUNTS[:3]).collect())  # noqa: B023, E731
        whole = held(toxicity._requests(tokens, pairs, 12))
        shares = [held(toxicity._requests(tokens, pairs, 12, None, lo, hi)) for lo, hi in ((0, 5), (5, 9), (9, 12))]
        assert all(shares) and sorted(sum(shares, [])) == whole


def test_places_on_disk_are_ranks(spark):
    text = " ".join(f"w{k % 7 if k % 3 else k}" for k in range(300))
    row = toxicity._chunks(spark.createDataFrame([(1, text, 0)], "_h long, text string, toxic int"), 40).first().asDict()
    rank = toxicity._unpack(row["ids"], np.int32)
    assert (np.diff(np.bincount(rank)) <= 0).all()
    words = toxicity.word_hashes(toxicity._tokens(text)) >> np.uint64(24)
    chunk = toxicity._Chunk(row)
    assert (chunk.vocabulary[chunk.ids] == words).all() and (np.diff(chunk.vocabulary.astype(np.int64)) > 0).all()


def test_parts_of_the_bitmap_ask_for_the_same_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 60)), i % 5) for i in range(60)]
    tokens = toxicity._chunks(spark.createDataFrame([(h, t, min(k, 2)) for h, t, k in rows], "_h long, text string, toxic int").coalesce(1), 40)
    chunk = toxicity._Chunk(tokens.first().asDict())
    chunk.pairs()
    blocks, bits = toxicity._known_blocks(tokens, 3600)
    sizes, answers = [], []
    for lo, hi in ((0, 5), (5, 9), (9, 12)):
        known = toxicity._bitmap(blocks, bits, 12, lo, hi)
        sizes.append(len(known[2]))
        part = toxicity._requests(tokens, True, 12, spark.sparkContext.broadcast(known), lo, hi)
        answers += [r.asDict() for r in toxicity._pair_sums(part, 12, 40).where("chunk >= 0").collect()]
    assert max(sizes) <= (1 << bits - 3) * 6 // 12
    asked = toxicity._holds(toxicity._known_pairs(tokens, 3600), chunk.keys, 40)
    assert 0 < asked.sum() < len(asked)
    # the answers say by themselves which pairs they are of
    assert (toxicity._asked(chunk.keys, answers, 12, 40) == asked).all()
    t, o = chunk.pair_counts()
    for c, want in (("a", t), ("b", o)):
        got = np.concatenate([toxicity._unpack(bytes(r[c]), np.int32) for r in sorted(answers, key=lambda r: r["bucket"])])
        assert (got == want[asked]).all()
    assert not (t + o)[~asked].any()


def test_no_bitmap_is_left_beside_the_features(spark, monkeypatch):
    held, features, left = [], toxicity._features, []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: held.append(broadcast(self, x)) or held[-1])
    monkeypatch.setattr(toxicity, "_features", lambda *x: left.append([b for b in held if b._jbroadcast.isValid()]) or features(*x))
    d = spark.createDataFrame([(i, f"thing{i % 7} {'vile scum' if i % 3 == 0 else 'kind'} rare{i}") for i in range(60)], "doc_id long, text string")
    toxicity.text_features(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    assert len(held) == toxicity.PAIR_SHARES and left and not any(left)


def test_the_driver_gives_native_memory_back(spark, monkeypatch):
    asked = []
    trimmed = common.trimmed
    monkeypatch.setattr(common, "trimmed", lambda s: asked.append(trimmed(s)))
    common.dropped(spark, common.saved(spark.range(3)))
    assert asked == [True]  # with glibc and a JDK of 17.0.9 or later
