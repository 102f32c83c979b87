"""Each operator on awkward tables, against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from ruleloom.llm import common, exact_dedup, fingerprints, lm, mixing, ngram_join, packing, quality, queries, sharding, substring_dedup, text_arrays, token_counts
from ruleloom.llm import components as component_steps
from ruleloom.llm.components import components
from tests.llm.cases import empty, long_text, odd, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return odd(spark).persist()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def test_empty_tables(spark):
    e = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        token_counts.count_tokens(e, MODEL), ngram_join.ngram_components(e), quality.classify(e, labels), sharding.shard(e), fingerprints.fingerprints(e),
        packing.pack(packing.pieces(e, *queries.byte_tokenizer())), mixing.mix(e), lm.score(e), substring_dedup.dedup(e), exact_dedup.exact_groups(e),
    ):
        assert out.count() == 0
    assert exact_dedup.drop_exact_duplicates(e).columns == ngram_join.drop_near_duplicates(e).columns == mixing.apply_mix(e).columns == quality.keep_good(e, labels).columns == e.columns


def test_scratch_tables_can_be_dropped(spark):
    before, own = list(common._WRITTEN), spark.range(3)
    common._WRITTEN.clear()
    try:
        kept = common.scratch(own, "kept")
        path = common._WRITTEN[0]
        assert kept.count() == 3 and common.drop_scratch(spark) == 1 and not common._WRITTEN
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)
    finally:
        common._WRITTEN.extend(before)


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_join_of_one_row_a_key(spark, monkeypatch, most):
    """Whether all keys are broadcast or only the hot ones, rows meet the row of their key."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", max(most, 200))
    monkeypatch.setattr(common, "HOT", 5)
    rows = [(k, i) for k in range(40) for i in range(30 if k == 7 else 2)] + [(99, 0)]
    keyed = spark.createDataFrame([(k, 30 if k == 7 else 2, f"v{k}") for k in range(40)], "k int, c int, v string")
    out = common.join_one(spark.createDataFrame(rows, "k int, i int"), keyed, "k", "c", 40).collect()
    assert sorted((r["k"], r["i"], r["v"]) for r in out) == sorted((k, i, f"v{k}") for k, i in rows if k < 40)


def test_token_counts(docs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = collections.Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in texts)
    assert collections.Counter(map(tuple, token_counts.count_tokens(docs, MODEL).collect())) == want


def test_token_counts_on_random_strings():
    sp, c, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_counts.PieceCounter(MODEL), random.Random(1)
    parts = ["a", "b", "th", " ", "  ", "\n", "é", "😀", "▁", "the", "1", "\x00", "日", "<s>", "</s>", "<unk>", "<0x0A>", "aaaa", "    ", "\t"]
    all_ = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["a" * 999, "ab" * 900, " " * 500, "日本" * 300, "=-" * 400]
    assert c.counts(all_) == [len(x) for x in sp.encode(all_)]


def brute_components(texts, n, num, den):
    sets = []
    for _, t, _ in texts:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    least = {}
    for r, (i, _, _) in zip(root, texts, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return collections.Counter((i, len(s), least[r] if s else i) for r, s, (i, _, _) in zip(root, sets, texts, strict=True))


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_ngram_join(docs, texts, n, num):
    got = ngram_join.ngram_components(docs, n, num, 100)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(texts, n, num, 100)


def test_ngram_join_leaves_near_threshold_templates_early(spark, monkeypatch):
    """Documents of one template just below the threshold: none links, and none goes on to be searched by parts."""
    monkeypatch.setattr(ngram_join, "LARGE", 16)
    body = [f"c{i}" for i in range(188)]
    texts = [" ".join([*body, *(f"own{d}x{i}" for i in range(12))]) for d in range(150)]
    searched, parts = [], ngram_join._Join.part_pairs
    monkeypatch.setattr(ngram_join._Join, "part_pairs", lambda self, open_, made: searched.append(open_.count()) or parts(self, open_, made))
    got = ngram_join.ngram_components(table(spark, texts), 3, 90, 100).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == 150 and not searched


@pytest.mark.parametrize("tile", [3, 2048])
def test_ngram_join_of_templates_around_the_threshold(spark, monkeypatch, tile):
    """As before, with own parts of several lengths, so that some link and buckets stay open for parts, in tiles."""
    for name, value in (("LARGE", 4), ("HUBS", 1), ("TILE", tile)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(tile)
    body = [f"c{i}" for i in range(120)]
    texts = [" ".join([*body[: rng.randint(100, 120)], *(f"own{d % 20}x{i}" for i in range(rng.randint(0, 12)))]) for d in range(60)]
    docs = table(spark, texts)
    got = ngram_join.ngram_components(docs, 3, 90, 100)
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, 3, 90, 100)


def test_ngram_join_on_clusters_beyond_a_bucket(spark, monkeypatch):
    """Near copies, chains and a passage that many share, with buckets made small so that hubs and the rest are used."""
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    monkeypatch.setattr(ngram_join, "CROWDED", 6)
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    rng, base, all_ = random.Random(2), long_text(11, 120).split(), []
    for k in range(60):
        w = base[:]
        for _ in range(k % 6):
            w[rng.randrange(120)] = f"e{k}"
        all_.append(" ".join(w))
    chain = long_text(13, 100).split()
    for k in range(25):
        chain = [*chain[2:], f"c{k}", f"d{k}"]
        all_.append(" ".join(chain))
    passage = long_text(17, 50)
    all_ += [f"{passage} {long_text(100 + k, 30)}" for k in range(40)]
    df = table(spark, all_)
    got = ngram_join.ngram_components(df, 3, 90, 100)
    want = brute_components([(i, t, None) for i, t in enumerate(all_)], 3, 90, 100)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    kept = ngram_join.drop_near_duplicates(df, 3, 90, 100)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in want}


def test_ngram_join_by_parts_alone(spark, monkeypatch):
    """Without rounds of hubs, what crowded buckets hold apart goes by parts."""
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    monkeypatch.setattr(ngram_join, "CROWDED", 6)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rng, base, all_ = random.Random(4), long_text(11, 90).split(), []
    for k in range(50):
        w = base[:]
        for _ in range(k % 4):
            w[rng.randrange(90)] = f"e{k}"
        all_.append(" ".join(w))
    all_ += [f"{long_text(17, 40)} {long_text(100 + k, 12)}" for k in range(30)]
    got = ngram_join.ngram_components(table(spark, all_), 3, 80, 100)
    want = brute_components([(i, t, None) for i, t in enumerate(all_)], 3, 80, 100)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2)])
def test_sets_that_reach_the_threshold_agree_in_a_part(num, den):
    rng, first = random.Random(num), ngram_join.bands(3000, num, den)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 5, 9, 10, 11, 30, 100, 400, 2000])
        a = {rng.getrandbits(64) for _ in range(n)}
        both = rng.randint(-(-num * n // den), n)
        b = set(rng.sample(sorted(a), both))
        room = den * both // num - n  # shingles that b may have besides
        b |= {rng.getrandbits(64) for _ in range(rng.choice([0, room]))}
        if b and den * len(a & b) >= num * len(a | b):
            x, y = (ngram_join.parts_of(np.array(sorted(s), np.uint64), first, num, den) for s in (a, b))
            assert set(x.tolist()) & set(y.tolist())


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d = (long_text(k, 60) for k in (3, 5, 7, 11))
    all_ = [(5, a), (5, b + " more"), (7, a + " more"), (3, b), (None, c), (None, d + " more"), (None, b + " other"), (9, d), (None, a + " other")]
    kept = ngram_join.drop_near_duplicates(spark.createDataFrame(all_, "doc_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(5, a), (3, b), (None, c), (9, d)], kept.schema).collect()))
    spaced = spark.createDataFrame([(None, c), (None, c.replace(" ", "  ")), (None, c + " more")], kept.schema)
    assert ngram_join.drop_near_duplicates(spaced).count() == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert {x: got.get(x, x) for x in root} == root


def test_components_end_with_settled_stars(spark, monkeypatch):
    """Stars take no round and a tree of two levels takes one; no further round only finds that nothing changes."""
    written, scratch = [], component_steps.scratch
    monkeypatch.setattr(component_steps, "scratch", lambda df, name: written.append(name) or scratch(df, name))
    for edges, rounds in (([(1, i) for i in range(2, 9)] * 2, 0), ([(1, 2), (1, 3), (2, 4), (2, 5), (3, 6)], 1), ([], 0), ([(3, 3)], 0)):
        written.clear()
        got = components(spark.createDataFrame(edges, "a int, b int")).collect()
        assert sorted(map(tuple, got)) == sorted({(x, 1) for e in edges for x in e if x > 1 and e[0] != e[1]})
        assert written.count("large-star") == rounds


@pytest.mark.parametrize("most", [0, 1 << 10, 64 << 20])
def test_ngram_join_broadcasts_or_shuffles_alike(spark, monkeypatch, most):
    """Whether tables are small enough for a broadcast or not, the same links are found."""
    for module in (common, component_steps, ngram_join):
        monkeypatch.setattr(module, "BROADCAST_BYTES", max(64, most))
    monkeypatch.setattr(common, "WIDE_BYTES", most)
    for name, value in (("LARGE", 3), ("CROWDED", 6), ("GROUP", 2), ("HUBS", 1), ("SENT", most)):
        monkeypatch.setattr(ngram_join, name, value)
    rng, base, all_ = random.Random(6), long_text(11, 90).split(), []
    for k in range(40):
        w = base[:]
        for _ in range(k % 5):
            w[rng.randrange(90)] = f"e{k}"
        all_.append(" ".join(w))
    body = [f"c{i}" for i in range(120)]
    all_ += [" ".join([*body[: rng.randint(100, 120)], *(f"own{d % 20}x{i}" for i in range(rng.randint(0, 12)))]) for d in range(40)]
    all_ += all_[:5] + [f"{long_text(17, 40)} {long_text(100 + k, 12)}" for k in range(20)]
    got = ngram_join.ngram_components(table(spark, all_), 3, 90, 100)
    want = brute_components([(i, t, None) for i, t in enumerate(all_)], 3, 90, 100)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


def test_ngram_join_writes_small_tables_in_few_files(spark, monkeypatch):
    """However many partitions the session deals, small tables get no more files than there are cores."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for name, value in (("LARGE", 4), ("CROWDED", 6), ("GROUP", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(common, "_WRITTEN", [])
    base = long_text(11, 60)
    all_ = [f"{base} e{k}" for k in range(60)] + [f"{long_text(3 + k, 50)} {base} {long_text(5 + k, 10)}" for k in range(60)]
    all_ += [f"{long_text(100 + k // 2, 70)}{' end' * (k % 2)}" for k in range(200)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = ngram_join.ngram_components(table(spark, all_), 3, 90, 100).collect()
        files = {re.search("ruleloom-([a-z-]+)-", path)[1]: len(list(Path(path.removeprefix("file:")).glob("part-*.parquet"))) for path in common._WRITTEN}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute_components([(i, t, None) for i, t in enumerate(all_)], 3, 90, 100)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert {"often", "group-pairs", "pairs", "verified", "least", "rooted"} <= set(files)
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_mixing_plans_without_python_workers(spark, docs):
    """The small tables of a plan come from the driver as Arrow, not through Python workers; empty ones, too."""
    for df in (docs, empty(spark)):
        rdd, before = [], spark.sparkContext.parallelize
        spark.sparkContext.parallelize = lambda *a, **b: rdd.append(a) or before(*a, **b)  # noqa: B023
        try:
            mixing.apply_mix(df).collect()
        finally:
            del spark.sparkContext.parallelize
        assert not rdd


def test_quality(spark, docs):
    good = [long_text(k, 80 + k) for k in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in t.split()) for t in good[:60]]
    df = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(360)] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    out = collected(quality.classify(df, labels))
    held = [r for r in out if r["held_out"]]
    assert len(out) == 360 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert np.mean([r["predicted"] == (r["doc_id"] < 300) for r in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    kept = {r["doc_id"] for r in quality.keep_good(df, labels).collect()}
    assert len(kept & set(range(300))) > 295 and len(kept & set(range(300, 360))) < 5
    again = quality.classify(docs, labels)
    assert again.count() == docs.count() and again.where("score is null").isEmpty()
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=quality.SIZE), rng.normal(size=(quality.RANK, quality.SIZE))
    of, i, x = quality.features([b"A tale of two two cities!", b"", b"words\nwords\nwords"])
    got = quality.raw_scores(0.3, w, v, of, i, x, 3)
    for t in range(3):
        f = [(a, b) for o, a, b in zip(of, i, x, strict=True) if o == t]
        pairs = sum(float(v[:, a] @ v[:, c]) * b * d for k, (a, b) in enumerate(f) for c, d in f[:k])
        assert math.isclose(got[t], 0.3 + sum(w[a] * b for a, b in f) + pairs, rel_tol=1e-9)


def test_sharding(spark, docs):
    hot = table(spark, ["hot text " * 5] * 400 + [long_text(k, 20 + k % 50) for k in range(800)] + [None, ""])
    for df in (docs, hot):
        out = collected(sharding.shard(df))
        assert len(out) == df.count()
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r)
        assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    load = [sum(r["size"] for r in rows) for rows in by.values()]
    assert len(load) == 8 and max(load) < 1.05 * min(load)
    homes = collections.defaultdict(set)
    for r in out:
        homes[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for c, s in homes.items() if c != zlib.crc32(b"hot text " * 5))
    assert sorted(map(str, collected(sharding.shard(hot)))) == sorted(map(str, out))


def test_fingerprints(docs, texts):
    order = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))
    out = collected(fingerprints.fingerprints(docs))
    assert len(out) == len(texts)
    by = collections.defaultdict(list)
    for i, t, _ in texts:
        by[i].append(t or "")
    unique = [i for i in by if len(by[i]) == 1]
    ids = [i for i, _, _ in order]
    for r in out:
        i = r["doc_id"]
        assert r["n_chars"] in {len(t) for t in by[i]} and 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        following = ids[(ids.index(i) + 1) % len(ids)] if i in unique else None
        if i in unique and following in unique:
            t, n = by[i][0], by[following][0]
            edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["fingerprint"] == fingerprints.digests([t.encode()])[0].tobytes().hex()
            assert r["edited_fingerprint"] == fingerprints.digests([edited.encode()])[0].tobytes().hex()


def test_fingerprint_counts_and_likeness():
    rng = random.Random(4)
    all_ = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 50, 4000)]
    assert (fingerprints._count(all_) == np.concatenate([fingerprints._count([t]) for t in all_])).all()
    assert fingerprints._count(all_).sum(axis=1).tolist() == [max(0, len(t) - 2) for t in all_]
    d = fingerprints.digests(all_)
    assert (fingerprints.likeness(d, d) == 1).all() and (fingerprints.likeness(d, d[::-1]) == fingerprints.likeness(d[::-1], d)).all()
    big = np.zeros((1, 1 + fingerprints.BUCKETS // 4), np.uint8)
    assert fingerprints.likeness(big, big + 255)[0] == 0


def test_packing(spark, docs, texts):
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {t: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in texts}
    out = collected(packing.pack(packing.pieces(docs, *queries.byte_tokenizer())))
    want = collections.Counter()
    for i, t, _ in texts:
        n = len(ids[t])
        cuts = [0, *range(n % 2048 or 2048, n, 2048), n]
        want.update((i, k, a, b - a, zlib.crc32(np.array(ids[t][a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[-1][0] + places[-1][1] <= 2048 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0
    assert len(by) <= math.ceil(sum(r["length"] for r in out) / 2048) + 1


def test_packing_in_blocks(spark):
    rng = random.Random(5)
    rows = [(i, 0, 0, rng.randint(1, 2048), i) for i in range(3000)]
    cut = spark.createDataFrame(rows, "_id long, piece int, start long, length long, ids_crc32 long")
    out = collected(packing.pack(cut, block=400))
    by = collections.Counter()
    for r in out:
        by[r["sequence_id"]] += r["length"]
    best = len(packing.best_fit([r[3] for r in rows]))
    assert len(out) == 3000 and max(by.values()) <= 2048 and len(by) <= 1.02 * best


def test_byte_tokens_match_the_library():
    tok, own, rng = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.ByteTokens(*queries.byte_tokenizer()), random.Random(6)
    parts = ["a", "b", "th", " ", "  ", "\n", "é", "😀", "\x1c", "\xa0", "the", "'s", "'ll", "1", "²", "\x00", "日本", "<|endoftext|>", "\t", "!", "\r\n", "_"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_local_search_raises_squared_fill():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randint(1, 900) for _ in range(12)]
        bins = [[i] for i in range(12)]
        out = packing.local_search(bins, sizes)
        fill = [sum(sizes[i] for i in b) for b in out]
        assert sorted(i for b in out for i in b) == list(range(12)) and max(fill) <= 2048
        assert sum(f * f for f in fill) >= sum(s * s for s in sizes) and len(out) <= len(packing.best_fit(sizes)) + 1


def test_mixing(spark, docs, texts):
    out = collected(mixing.mix(docs))
    size = {t: len(WORD.findall(t or "")) for _, t, _ in texts}
    assert len(out) == len(texts)
    total = collections.Counter()
    for _, t, s in texts:
        total[s] += size[t]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    want = [float(x) for x in mixing.targets([total[s] for s in names], [1 + k % 3 for k in range(len(names))])]
    assert sorted({(r["source_size"], r["target"]) for r in out}) == sorted((total[s], t) for s, t in zip(names, want, strict=True))
    taken = collections.Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["whole"] * r["size"] + r["part"]
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - t) <= 1 for (_, t), n in taken.items())
    assert sorted(map(str, out)) == sorted(map(str, collected(mixing.mix(docs.repartition(3)))))


def test_targets_stop_and_reshare():
    assert [float(x) for x in mixing.targets([10, 100, 1000], [1, 2, 3])] == [30.0, 300.0, 780.0]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.whole_targets(mixing.targets([1, 1, 1], [1, 1, 1])) == [1, 1, 1]


def test_flow_is_least_costly():
    """Against all ways to route small overlapping patterns."""
    rng = random.Random(8)
    for _ in range(60):
        patterns = [(m, rng.randint(0, 3)) for m in ([0], [1], [0, 1])]
        quotas = [rng.randint(0, 9), rng.randint(0, 9)]
        taken = mixing.route(patterns, quotas)

        def cost(p, n, patterns=patterns):
            return sum(min(patterns[p][1], max(0, n - k * patterns[p][1])) * k for k in range(3))

        best = None
        caps = [3 * n for _, n in patterns]
        for a in range(caps[0] + 1):
            for b in range(caps[1] + 1):
                for c0 in range(caps[2] + 1):
                    for c1 in range(caps[2] - c0 + 1):
                        if a + c0 <= quotas[0] and b + c1 <= quotas[1]:
                            key = (-(a + b + c0 + c1), cost(0, a) + cost(1, b) + cost(2, c0 + c1))
                            best = key if best is None or key < best else best
        assert (-sum(taken), sum(cost(p, n) for p, n in enumerate(taken))) == best


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * (5 + i % 7), [["a"], ["b"], ["a", "b"]][i % 3]) for i in range(90)]
    out = collected(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")))
    assert sum(r["taken"] for r in out) == sum(r["size"] for r in out)


def test_applied_mix(spark):
    df = table(spark, [long_text(k, 10 + k) for k in range(40)], lambda i: "a" if i < 35 else "b")
    out = mixing.apply_mix(df, length_col="n_chars").collect()
    plan = {r["doc_id"]: r for r in collected(mixing.mix(df))}
    words = collections.Counter()
    for r in out:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(words[i] == r["taken"] for i, r in plan.items()) and out[0].__fields__ == df.columns


def test_pipeline_mixes_whole_documents(spark):
    df = table(spark, [long_text(k, 10 + k) for k in range(40)], lambda i: "a" if i < 35 else "b")
    plan, text = {r["doc_id"]: r for r in collected(mixing.mix(df))}, {r["doc_id"]: r["text"] for r in df.collect()}
    assert any(r["part"] for r in plan.values())
    out = corpus_pipeline.mixed(spark, df, "").collect()
    assert all(r["text"] == text[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out)
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter({i: r["whole"] + (2 * r["part"] >= r["size"]) for i, r in plan.items() if r["whole"] or 2 * r["part"] >= r["size"]})


def brute_ppm(training, text):
    k, stream = lm.ORDER, lambda t: " ".join(WORD.findall(lower(t))).encode() + b"\n"
    count = [collections.defaultdict(collections.Counter) for _ in range(k + 1)]
    for t in training:
        b = b"\n" * k + stream(t)
        for p in range(k, len(b)):
            for j in range(k + 1):
                count[j][b[p - j : p]][b[p]] += 1
    b, out = b"\n" * k + stream(text), 0.0
    for p in range(k, len(b)):
        gone, done = set(), False
        for j in range(k, -1, -1):
            context = count[j].get(b[p - j : p])
            if not context:
                continue
            left = {s: c for s, c in context.items() if s not in gone}
            n = sum(left.values())
            if b[p] in left:
                out, done = out + math.log10((2 * left[b[p]] - 1) / (2 * n)), True
                break
            if left:
                out += math.log10(len(left) / (2 * n))
            gone |= set(context)
        if not done:
            out -= math.log10(256 - len(gone))
    return out


@pytest.mark.parametrize("common", [200_000, 3])
def test_lm(docs, texts, common):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in texts}
    training = [t for i, t, _ in texts if not held[i]]
    c = collections.Counter(w for t in training for w in [*WORD.findall(lower(t)), "\n"])
    n, v = sum(c.values()), len(c)
    out = collected(lm.score(docs, common=common))
    assert len(out) == len(texts)
    by = collections.defaultdict(set)
    for i, t, _ in texts:
        w = [*WORD.findall(lower(t)), "\n"]
        by[i].add((len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4), t))
    cost = {}
    for r in out:
        assert r["held_out"] == held[r["doc_id"]] and r["train_tokens"] == n
        mine = [x for x in by[r["doc_id"]] if x[:2] == (r["n_tokens"], r["n_known"]) and abs(x[2] - r["base_score"]) < 1e-3]
        assert mine
        if len(by[r["doc_id"]]) == 1 and common > 3 and r["n_tokens"] < 200:
            t = mine[0][3]
            cost.setdefault(t, brute_ppm(training, t))
            assert abs(cost[t] - r["score"]) < 1e-3


@pytest.mark.parametrize("nodes", [0, 40])
def test_lm_counts_grams_beyond_the_nodes(spark, nodes):
    """What the workers hold sets the speed only: rare grams and all shorter contexts count as well."""
    all_ = ["the cat sat on the mat", "the cat ate the rat", "a rat and a cat", "zebra xylem", "the bat sat", "on the mat a rat", "the unseen quokka", "cat", None, "é 日本", "the cat sat on a xylem", "zq"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(all_))]
    assert any(held)
    training = [t for t, h in zip(all_, held, strict=True) if not h]
    out = {r["doc_id"]: r["score"] for r in collected(lm.score(table(spark, all_), nodes=nodes))}
    for i, t in enumerate(all_):
        assert abs(out[i] - brute_ppm(training, t)) < 1e-4


def test_lm_streams_of_texts_in_pieces(monkeypatch):
    text = [b"some words here and there " * 40, b"", b"tail"]
    whole = sorted(x for g, *_ in lm.grams(text) for x in g.tolist())
    monkeypatch.setattr(text_arrays, "PIECE", 64)
    assert sorted(x for g, *_ in lm.grams(text) for x in g.tolist()) == whole


def test_word_hashes(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["Ab", "ab", "é", "x" * 200, "longer", "\x00"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(50)]
    h, first = text_arrays.word_hashes(texts)
    number = {}
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        words = t.lower().split()
        assert b - a == len(words)
        for w, x in zip(words, h[a:b].tolist(), strict=True):
            assert number.setdefault(w, x) == x
    assert len(set(number.values())) == len(number)
    monkeypatch.setattr(text_arrays, "PIECE", 50)
    again, where = text_arrays.word_hashes(texts)
    assert (again == h).all() and (where == first).all()


def test_substring_dedup(spark, docs, texts):
    line = "This very line recurs in several of the documents here."
    all_ = [f"First text.\n{line}\nIts own end.", f"Second. {line.upper()} And more of it follows.", f"Third\n  {line}  \n{line}", "Short one.\nShort one."]
    out = {r["doc_id"]: r for r in collected(substring_dedup.dedup(table(spark, all_)))}
    cut = {i: [all_[i][s["start"] : s["end"]] for s in r["removed"]] for i, r in out.items()}
    assert cut == {0: [], 1: [line.upper()], 2: [line, line], 3: []}
    assert out[1]["kept_text"] == "Second. And more of it follows." and out[0]["kept_text"] == all_[0] and out[3]["n_units"] == 2
    whole = collected(substring_dedup.dedup(docs))
    assert len(whole) == len(texts) and all(r["n_removed"] == len(r["removed"]) for r in whole)
    seen, want = set(), collections.defaultdict(list)
    for i, t in sorted({(i, t or "") for i, t, _ in texts if i is not None}):
        for a, b, normal in substring_dedup.units(t):
            if normal.count(" ") + 1 >= substring_dedup.MIN_WORDS:
                if normal in seen:
                    want[i].append((a, b))
                seen.add(normal)
    assert all([(s["start"], s["end"]) for s in r["removed"]] == want[r["doc_id"]] for r in whole if r["doc_id"] is not None)


def test_substring_dedup_of_short_sentences_and_lines(spark):
    """A passage of short sentences, a line's short tail and a list of short lines go; what stands first stays whole."""
    passage = "Ha by, orwh. Of it nd. Reha one. Ti."
    line = "This very line recurs in several of the documents here. And so on."
    list_ = "Apples\nRed pears\n\nPlums too\nFigs"
    all_ = [f"Start. {passage}\n{line}\nMiddle.\n{list_}\nEnd.", f"Other start.\nAn. {passage} Ok.", f"{line}\nNew words.", f"Shopping:\n{list_}\nDone.", "Go on. " * 8]
    out = {r["doc_id"]: r for r in collected(substring_dedup.dedup(table(spark, all_)))}
    cut = {i: " ".join(all_[i][s["start"] : s["end"]] for s in r["removed"]) for i, r in out.items()}
    assert cut == {0: "", 1: passage, 2: line, 3: " ".join(list_.split()), 4: " ".join(["Go on."] * 5)}
    assert out[0]["kept_text"] == all_[0] and out[4]["kept_text"].split() == ["Go", "on."] * 3


def brute_passages(all_, least):
    """Numbers of the lines to remove: those of later copies of the shortest runs of lines with so many words."""
    lines = {i: [(m.start() + len(m.group()) - len(m.group().lstrip()), " ".join(m.group().lower().split())) for m in re.finditer(r"[^\n]+", t or "") if m.group().split()] for i, t in all_.items()}
    seen, gone = {}, {i: set() for i in all_}
    for i in sorted(all_):
        own = lines[i]
        words = [len(x.split()) for _, x in own]
        runs = [(a, b) for a in range(len(own)) for b in range(a, len(own)) if sum(words[a : b + 1]) >= least > min(sum(words[a:b]), sum(words[a + 1 : b + 1]))]
        for a, b in sorted(runs):
            key = tuple(x for _, x in own[a : b + 1])
            if key in seen:
                of, upto = seen[key]
                gone[i] |= {k for k in range(a, b + 1) if of != i or k > upto}
            else:
                seen[key] = (i, b)
    return {i: sorted(own[k][0] for k in gone[i]) for i, own in lines.items()}


def test_substring_dedup_by_lines(spark):
    rng = random.Random(12)
    pool = [long_text(k, rng.choice([3, 9, 30, 60, 90])) for k in range(14)]
    all_ = {i: "\n".join(rng.choice(["", "  "]) + (rng.choice(pool) if rng.random() < 0.5 else long_text(1000 + 40 * i + k, rng.randint(1, 70))) for k in range(rng.randint(0, 9))) for i in range(60)}
    all_ |= {60: None, 61: "\n\n", 62: f"{pool[3]}\n{pool[4]}", 63: f"{pool[3].upper()}\n\n{pool[4]}", 64: "\n".join([pool[1]] * 12)}
    df = table(spark, [all_[i] for i in range(len(all_))])
    for least in (50, 1):
        out = {r["doc_id"]: r for r in collected(substring_dedup.dedup(df, min_words=least, unit="line"))}
        want = brute_passages(all_, least)
        assert sum(map(len, want.values())) > 20
        for i, r in out.items():
            assert r["n_removed"] == len(want[i]) and [s["start"] for s in r["removed"]] == want[i]
            assert all((all_[i] or "")[s["start"] : s["end"]].lower().split() for s in r["removed"])
    assert all(c["n_removed"] == 0 for c in collected(queries.dedup(df.where("doc_id in (60, 61)"))))


def brute_words(all_, least, gone):
    """Places of the words to remove: those of later copies of windows of words that haven't all gone with whole lines."""
    seen, out = {}, {}
    for i in sorted(all_):
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", all_[i] or "")]
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), all_[i][a:b]) for a, b in at]
        lost = {k for k, (a, b) in enumerate(at) if any(x <= a and b <= y for x, y in gone[i])}
        new = set()
        for k in range(len(at) - least + 1):
            if not lost.issuperset(range(k, k + least)):
                of, upto = seen.setdefault(tuple(words[k : k + least]), (i, k + least))
                if (of, upto) != (i, k + least):
                    new |= {x for x in range(k, k + least) if of != i or x >= upto}
        out[i] = {at[k] for k in lost | new}
    return out


def test_substring_dedup_inside_lines(spark):
    """A copied passage goes wherever it begins and ends in longer lines, and across lines; shorter repeats stay."""
    rng = random.Random(5)
    pool = [long_text(k, 90) for k in range(6)]
    cut = lambda: " ".join(rng.choice(pool).split()[rng.randint(0, 30) :][: rng.randint(20, 60)])
    all_ = {i: "".join(rng.choice(["\n", " ", "  ", " "]) + (cut() if rng.random() < 0.4 else long_text(1000 + 40 * i + k, rng.randint(1, 40))) for k in range(rng.randint(0, 12))) for i in range(60)}
    all_ |= {60: None, 61: " \n", 62: all_[3].upper(), 63: "go on " * 60, 64: f"{pool[0]}\n{pool[1]}", 65: f"{pool[0]}\n{pool[1]}", 66: f"x {pool[0]} {pool[1]} y"}
    df = table(spark, [all_[i] for i in range(len(all_))])
    for least, inside in ((50, 50), (50, 7), (10, 1)):
        lines = {r["doc_id"]: r for r in collected(substring_dedup.dedup(df, min_words=least, unit="line"))}
        out = {r["doc_id"]: r for r in collected(substring_dedup.dedup(df, min_words=least, unit="line", passage_words=inside))}
        want = brute_words(all_, inside, {i: [(s["start"], s["end"]) for s in r["removed"]] for i, r in lines.items()})
        for i, r in out.items():
            text = all_[i] or ""
            words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
            got = [(s["start"], s["end"]) for s in r["removed"]]
            assert {w for w in words if any(a <= w[0] and w[1] <= b for a, b in got)} == want[i] and r["n_removed"] == len(got)
            assert r["kept_text"].split() == [text[a:b] for a, b in words if (a, b) not in want[i]] and got == sorted(got)
        assert sum(r["n_removed"] > lines[i]["n_removed"] for i, r in out.items()) > 5
    assert out[66]["kept_text"].split() == ["x", "y"]


def test_registered_substring_dedup_finds_passages_inside_lines(spark, tmp_path):
    """Of texts that share 52 words amid a line the first stays; 40 shared words stay."""
    shared, short = long_text(3, 52), long_text(4, 40)
    texts = [f"{long_text(50 + i, 30)} {(shared, short)[i % 2]} {long_text(70 + i, 30)}" for i in range(8)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in collected(queries.op9_substring_dedup(spark, str(tmp_path)))}
    assert {i: [texts[i][s["start"] : s["end"]] for s in r["removed"]] for i, r in out.items()} == {i: [shared] if i in (2, 4, 6) else [] for i in range(8)}


def test_substring_dedup_without_broadcasts(spark, docs, texts, monkeypatch):
    """Null ids, repeated rows and joins that shuffle both sides: the same spans, and one row per row."""
    ask = lambda: sorted(str(r) for r in substring_dedup.dedup(docs, min_words=50, unit="line", passage_words=20).collect())
    want = ask()
    assert len(want) == len(texts) and sum("n_removed=0" not in r for r in want) > 3
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(substring_dedup, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(substring_dedup, "WINDOW_BYTES", 1)
    assert ask() == want


def test_exact_dedup(docs, texts):
    normal = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in texts]
    groups = collections.defaultdict(list)
    for i, t in normal:
        groups[t].append(i)
    out = collected(exact_dedup.exact_groups(docs))
    key = lambda r: (r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])
    want = collections.Counter((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in normal)
    assert collections.Counter(map(key, out)) == want
    assert collections.Counter(r["text_sha256"] for r in out if r["kept"]) == collections.Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_with_a_full_filter(spark, monkeypatch):
    """False positives shuffle and change nothing."""
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 64)
    monkeypatch.setattr(exact_dedup, "power_of_two", lambda *_: 64)
    df = table(spark, [f"t{i % 400}" for i in range(500)])
    out = collected(exact_dedup.exact_groups(df))
    assert sum(r["kept"] for r in out) == 400 and all(r["keep_id"] == r["doc_id"] % 400 for r in out)


def test_exact_dedup_with_a_filter_in_buckets(spark, docs, texts, monkeypatch):
    """A filter that isn't broadcast gives the same groups; of rows that agree in all but white space one stays."""
    want = sorted(map(str, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "broadcast_if_small", lambda df, _: df)
    assert sorted(map(str, exact_dedup.exact_groups(docs).collect())) == want
    df = spark.createDataFrame([(1, "a  b"), (1, "a b"), (1, "a b"), (None, "a b"), (2, "c"), (0, "d"), (3, "a\tb")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df).collect()) == [0, 1, 2]


def test_exact_dedup_runs_no_python(spark):
    plan = queries.op10_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
