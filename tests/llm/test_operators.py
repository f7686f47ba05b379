"""Corpus operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.llm import bpe, bytecnn, exact_dedup, knn, licenses, minhash, mixing, sharding, suffixes, textnp, toxicity
from wavemill.llm.common import file_backed
from wavemill.llm.queries import id_remainder, vocabulary

EXTRA = "doc_id bigint, text string, source string, size int, target string, score double, digest string, bucket int, n int, locator string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(seed: int = 0, count: int = 60) -> list[str | None]:
    """Prose with exact copies, near copies, shared passages, empties and a long text."""
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    passage = prose(60)
    out: list[str | None] = [None, "", "one", "one", " \t\n", "Two words", "two WORDS", "é" * 60, prose(3000)]
    while len(out) < count:
        base = prose(rng.randrange(5, 120))
        out.append(base)
        if rng.random() < 0.3:
            out.append(base)
        if rng.random() < 0.4:
            w = base.split()
            w[rng.randrange(len(w))] = "edited"
            out.append(" ".join(w))
        if rng.random() < 0.3:
            out.append(base[:20] + passage + base[20:])
    return out


def documents(spark, rows=None, repeat: bool = True):
    """The fixture as a table whose other columns clash with the operators' names; one row is there twice."""
    rows = texts() if rows is None else rows
    data = [(i, t, None if i % 7 == 3 else f"s{i % 4}", 1, "x", 0.5, "d", 3, 4, "l") for i, t in enumerate(rows)]
    return spark.createDataFrame(data + (data[10:11] if repeat and len(data) > 10 else []), EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


# Exact deduplication


def brute_classes(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return by


def test_exact_dedup(spark):
    df = documents(spark)
    got = exact_dedup.exact_dedup(df).collect()
    by = brute_classes([(r.doc_id, r.text) for r in df.collect()])
    text = {i: t for t, ids in by.items() for i in ids}
    assert len(got) == df.count()
    for r in got:
        ids = by[text[r.row_id]]
        assert (r.keep_id, r.group_size) == (max(ids), len(ids))
        assert r.digest == hashlib.sha256(text[r.row_id].encode()).hexdigest()
    assert Counter(text[r.row_id] for r in got if r.kept) == Counter(dict.fromkeys(by, 1))


def test_exact_dedup_keeps_columns_and_one_row(spark):
    df = documents(spark)
    kept = exact_dedup.dedup_documents(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in brute_classes([(r.doc_id, r.text) for r in df.collect()]).values())


def test_exact_dedup_null_ids_and_empty(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b")], "doc_id bigint, text string")
    got = sorted(((r.row_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()), key=str)
    assert got == [(3, 3, 3, True), (None, 3, 3, False), (None, 3, 3, False), (None, None, 1, True)]
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_over_several_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"{k % 4}", i * 10 + k, f"l{i}{k}", "r") for k in range(6)], "digest string, row_id bigint, locator string, run string").coalesce(
            1
        ).write.mode("append").parquet(str(tmp_path / "d"))
    narrow = spark.read.parquet(str(tmp_path / "d"))
    got = {r.digest: (r.keeper.row_id, r.group_size) for r in exact_dedup.stream_state(narrow, str(tmp_path / "d"), files_per_batch=1).collect()}
    assert got == {"0": (24, 6), "1": (25, 6), "2": (22, 3), "3": (23, 3)}


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path, monkeypatch):
    """A second run is held against the first, and one that is killed is repeated without counting anything twice."""
    state = f"file://{tmp_path}/state"
    schema = "doc_id bigint, text string"
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (9, "d")], schema)
    second = spark.createDataFrame([(4, "a"), (0, "b"), (5, "c"), (6, "c"), (9, "d")], schema)
    got = {r.row_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(first, state=state, run="1").collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 9: (9, 1, True)}
    emitted = []

    def killed(*_):
        emitted.append(1)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "_collided", killed)
        with pytest.raises(RuntimeError):
            exact_dedup.exact_dedup(file_backed(second), state=state, run="2")
    assert emitted
    for _ in range(2):
        got = sorted((r.row_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(second, state=state, run="2").collect())
        assert got == [(0, 2, 2), (4, 4, 3), (5, 6, 2), (6, 6, 2), (9, 9, 2)]
    third = spark.createDataFrame([(7, "a"), (None, "e")], schema)
    got = sorted((str(r.row_id), r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(third, state=state, run="3").collect())
    assert got == [("7", 7, 4), ("None", None, 1)]


def test_exact_dedup_checks_bytes_of_earlier_runs(spark, tmp_path, monkeypatch):
    """Should a digest come with another text in a later run, the content met first tells."""
    schema = "doc_id bigint, text string"
    state = f"file://{tmp_path}/state"
    monkeypatch.setattr(exact_dedup, "digests", lambda docs, key, text: docs.select(F.lit("same").alias("digest"), docs[key].alias("row_id"), exact_dedup._locator(docs).alias("locator")))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("same"))
    exact_dedup.exact_dedup(spark.createDataFrame([(1, "a")], schema), state=state, run="1").collect()
    rows = exact_dedup.exact_dedup(spark.createDataFrame([(2, "b"), (3, "b")], schema), state=state, run="2").collect()
    assert sorted((r.row_id, r.keep_id, r.group_size) for r in rows) == [(2, 3, 2), (3, 3, 2)]


def test_exact_dedup_collisions_are_split_by_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    df = file_backed(df)
    bad = spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(),) for t in "ab"], "digest string")
    rows = exact_dedup._by_text(df, bad, "doc_id", "text").collect()
    assert {(r.row_id, r.keeper.row_id, r.group_size) for r in rows} == {(1, 3, 2), (2, 2, 1), (3, 3, 2)}


# MinHash


def brute_near(rows):
    sets = {}
    for i, t in rows:
        t = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for c in "\t\n\x0b\x0c\r":
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_minhash(spark):
    df = documents(spark, texts(1, 120))
    want = brute_near([(r.doc_id, r.text) for r in df.collect()])
    got = minhash.near_dedup(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_minhash_links_that_stars_miss(spark):
    # A chain: neighbours are alike, the ends are not, and the least is at one end.
    w = [f"w{k}" for k in range(200)]
    chain = [" ".join(w[k * 12 : k * 12 + 100]) for k in range(6)]
    want = brute_near(list(enumerate(chain)))
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(documents(spark, chain, False)).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_minhash_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(24):
        w = list(base)
        for k in rng.sample(range(60), 3):
            w[k] = f"x{rng.randrange(999)}"
        rows.append(" ".join(w))
    want = brute_near(list(enumerate(rows)))
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(documents(spark, rows, False)).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_minhash_repeated_ids_with_unlike_texts(spark):
    """An id whose rows have several texts is linked to all that any of them is linked to, in whatever order rows come."""
    w = [f"w{k}" for k in range(200)]
    one, two, three = (" ".join(w[a : a + 60]) for a in (0, 60, 120))
    rows = [(5, one), (1, one), (5, two), (2, two + " more"), (2, three), (7, three), (9, "of its own text"), (9, "and another one")]
    want = {(i, t): 1 for i, t in rows if i < 9} | {(i, t): 9 for i, t in rows if i == 9}
    for data in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(data, "doc_id bigint, text string")
        got = minhash.near_dedup(df).collect()
        assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter((i, c, i == c) for (i, _), c in want.items())


def test_minhash_large_open_buckets(spark, monkeypatch):
    """Pruning and size classes lose no link: many unlike members of one boilerplate, some of them alike."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 4)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(40):
        tail = [f"t{i}x{k}" for k in range(rng.randrange(2, 30))]
        rows.append(" ".join(base + tail))
        if i % 4 == 0:
            rows.append(" ".join(base + tail[:-1] + ["z"]))
    want = brute_near(list(enumerate(rows)))
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(documents(spark, rows, False)).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


@pytest.mark.parametrize("size", [3, 10, 100])
def test_recall_of_bands(size):
    """Pairs at or just over the threshold share a band but for a few in a hundred thousand, however few shingles they have."""
    rng = np.random.default_rng(size)
    both, own = 3 * size, size  # similarity 0.75
    shared = 0
    for _ in range(3000):
        x = rng.integers(0, 2**64, both + own, dtype=np.uint64)
        a, b = np.unique(x), np.unique(x[own:])
        assert 100 * both >= 75 * len(a)
        shared += bool(np.any(minhash.bands(minhash.sketch(a)) == minhash.bands(minhash.sketch(b))))
    assert shared >= 2999


def test_minhash_empty_and_null_ids(spark):
    assert minhash.near_dedup(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(rows).collect()), key=str)
    assert got == [(4, 4, True), (None, None, True), (None, None, True)]


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for size in (3, 40, 900):
        agree = []
        for _ in range(300 if size < 100 else 60):
            x = rng.permutation(np.unique(rng.integers(0, 2**64, size * 2, dtype=np.uint64)))
            a, b = np.sort(x[: int(size * 1.5)]), np.sort(x[size // 2 :][: int(size * 1.5)])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((minhash.sketch(a) == minhash.sketch(b)).mean() - j)
        assert abs(np.mean(agree)) < 0.03


# Mixing


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), None if i % 5 == 4 else f"s{i % 5}") for i in range(400)]
    rows += [(400, None, "s0"), (401, "  ", "s9"), (402, "a b", "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = Counter()
    for i, _, s in rows:
        by[s] += size[i]
    order = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, free, target = 1.5 * sum(by.values()), set(order), {}
    while True:  # reshare the excess until no source is above
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * by[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * by[s]
            free.remove(s)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df.repartition(7)).collect()))
    stream = mixing.mix(df, position="at")
    assert stream.columns == ["doc_id", "text", "source", "at"]
    places = [r["at"] for r in stream.collect()]
    assert places == sorted(places) and len(places) == sum(len(r.uses) for r in got)


def test_positions_invert_the_integrated_schedules(spark):
    """Each use's position against a fine numeric integral of its source's schedule."""
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), f"s{rng.randrange(4)}") for i in range(300)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    target = {r.source: r.target for r in got}
    demand = sum(target.values())
    grid = np.linspace(0, 1, 200_001)
    for nth, source in enumerate(sorted(target)):
        weight = np.interp(grid, *zip(*mixing.SCHEDULES[nth % 3]))
        used = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        used = used / used[-1] * target[source]
        start = 0
        for r in sorted((r for r in got if r.source == source), key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
            want = []
            for k in range(2):
                middle = start + k * r.source_size + r["size"] / 2
                if r["size"] and middle < r.target:
                    want.append((k, np.interp(middle, used, grid) * demand))
            assert [u["pass"] for u in r.uses] == [k for k, _ in want]
            assert [u.position for u in r.uses] == pytest.approx([p for _, p in want], abs=demand * 1e-4)
            start += r["size"]


def test_mixing_edges(spark):
    assert mixing.plan(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    df = documents(spark)
    assert mixing.plan(df).count() == df.count() and mixing.mix(df).columns == df.columns
    blank = spark.createDataFrame([(1, None, None), (1, "", "a"), (None, " ", "a")], "doc_id bigint, text string, source string")
    assert [r.taken for r in mixing.plan(blank).collect()] == [0, 0, 0]


def test_schedules_integrate_to_one(spark):
    shares = [k / 50 for k in range(51)]
    for s in mixing.SCHEDULES:
        df = spark.createDataFrame([(x,) for x in shares], "x double").select(mixing.moment(F.col("x"), s).alias("t"))
        area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(s, s[1:]))
        for x, (t,) in zip(shares, df.collect()):
            grid = np.linspace(0, t, 2001)
            used = np.trapezoid(np.interp(grid, [p for p, _ in s], [w for _, w in s]), grid) / area
            assert used == pytest.approx(x, abs=1e-5)


# Licences


def test_templates_accept_what_their_patterns_do():
    import re

    rng = random.Random(4)
    for label, template in licenses.TEMPLATES.items():
        a, pattern = licenses.compiled(template), re.compile(licenses.as_pattern(template))
        words = re.findall(r"[a-z0-9]+", re.sub(r"<[^>]*>", " ", template))
        for _ in range(200):
            text = list(words)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(text) + 1)
                if rng.random() < 0.5:
                    text.insert(k, rng.choice(["foo", "the", "mit"]))
                elif text:
                    text.pop(min(k, len(text) - 1))
            hashes = [licenses.word_hash(w) for w in text]
            found = any(a.match(hashes[i:]) for i in range(len(hashes)))
            assert found == bool(pattern.search(" " + " ".join(text))), (label, text)


def test_license_scan(spark):
    rows = [None, "", "Released under the MIT License.", "x MIT  license mit-LICENSE", "the mit", "license", "Licensed under the Apache License, Version 2.0."]
    rows += ["word " * 30000 + "GNU General Public License", "mit éé license", "MIT\u00a0license"]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows, False).withColumn("matches", F.lit(1))).collect()}
    labels = {i: [(m.label, m.template, m.first_word) for m in r.matches] for i, r in got.items()}
    assert [got[i].n_words for i in range(7)] == [0, 0, 5, 5, 2, 1, 8]
    assert labels[2] == [("mit-notice", True, 1), ("mit", False, 3)]
    assert labels[3] == [("mit", False, 1), ("mit", False, 3)]
    assert [labels[i] for i in (4, 5, 8, 9)] == [[], [], [], []]  # a no-break space is part of a word
    assert ("apache-2.0", True, 0) in labels[6]
    assert labels[7] == [("gpl", False, 30001)]
    assert licenses.scan(empty(spark).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("bad", ["[a", "a]", "[a]", "<x:3>", ""])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        licenses.parse(bad)


# Suffix arrays


def brute_repeats(rows):
    first, out = {}, {}
    data = sorted({(i, (t or "").encode()) for i, t in rows})
    for i, b in data:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g))
    return out


SMALL_SIZES = {"bucket_bytes": 2000, "piece": 300}


@pytest.mark.parametrize("sizes", [{}, {"pack": 3000} | SMALL_SIZES, {"pack": 1000, "hot": 2} | SMALL_SIZES, {"pack": 1000, "hot": 4}])
def test_repeats(spark, sizes):
    """Small sizes make many packs and blocks, and texts in parts; strings at hot anchors that no other document has are left out."""
    rows = texts(3, 80)
    rows += ["a" * 130, "ab" * 70, "x" * 49, "a" * 60, "Ünïcödé " * 20, "z" + "Ünïcödé " * 20]
    df = documents(spark, rows)
    want = brute_repeats([(r.doc_id, r.text) for r in df.collect()])
    got = suffixes.remove_repeats(df, **sizes).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_repeats_edges(spark):
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    same = "q" * 30 + "r" * 30
    rows = spark.createDataFrame([(None, same), (None, same), (5, same), (7, same), (7, same)], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_removed) for r in suffixes.remove_repeats(rows).collect())
    assert got == {(None, 60): 2, (5, 0): 1, (7, 60): 2}


def test_two_stage_sort():
    rng = random.Random(6)
    for _ in range(60):
        parts = [bytes(rng.choice(b"abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(50, 90))) for _ in range(3)]
        text = np.zeros(sum(map(len, parts)) + 3 + 64, np.uint8)
        at, wanted = 0, np.zeros(len(text), bool)
        for p in parts:
            text[at : at + len(p)] = np.frombuffer(p, np.uint8) + 1
            wanted[at : at + len(p) - 49] = True
            at += len(p) + 1
        order = suffixes.sort_suffixes(text, wanted)
        raw = text.tobytes()
        keys = [raw[i : i + 50] for i in order]
        assert sorted(order) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)
        lcp = suffixes.common_prefixes(text, order)
        for a, b, n in zip(keys, keys[1:], lcp[1:]):
            assert n == next((k for k in range(50) if a[k] != b[k]), 50)


# Nearest vectors


def brute_top(rows, every, k):
    data = []
    for i, x in rows:
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x):
            data.append((i, [int(np.floor(256 * np.float64(np.float32(v)))) for v in x]))
    out = set()
    for i, q in data:
        if i % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in data if j != i)
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize("block, part", [(4096, 4096), (16, 5)])
def test_knn(spark, block, part, monkeypatch):
    monkeypatch.setattr(knn, "TILE", 8)
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(v) for v in np.float32(centers[i % 6] + rng.normal(0, 0.2, 8))]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(80)]  # one common vector
    rows += [(500, None), (501, []), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, [1.0] * 8), (510, [1.0, 2.0])]
    df = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id bigint, embedding array<float>, cell string, part int")
    got = {tuple(r) for r in knn.knn(df, knn.divisible(10), block=block, part=part).collect()}
    assert got == brute_top(rows, 10, 5)


@pytest.mark.parametrize("size", [1e6, 6e9])
def test_knn_large_components(spark, size):
    """Exact where doubles are not, and where 64 bits don't hold a sum of products on its way."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in np.float32(rng.normal(0, size if i % 3 else 1, 16))]) for i in range(90)]
    rows += [(90 + i, rows[i][1][:-1] + [rows[i][1][-1] + 0.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in knn.knn(df, knn.divisible(5)).collect()}
    assert got == brute_top(rows, 5, 5)


def test_knn_bounds_prune_clustered_vectors(spark):
    """Vectors in clusters go to few groups; the result is that of brute force."""
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (40, 16))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    rows = [(i, [float(v) for v in np.float32(3 * centers[i % 40] + rng.normal(0, 0.02, 16))]) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    spread, _, _ = knn.replicated(df, knn.divisible(50), 5, "vec_id", "embedding", 4096, 4096)
    counts = spread.groupBy("is_query").count().collect()
    moved = {r.is_query: r["count"] for r in counts}
    assert moved[True] == 24 and moved[False] < 0.8 * len(rows)
    assert {tuple(r) for r in knn.knn(df, knn.divisible(50)).collect()} == brute_top(rows, 50, 5)


def test_knn_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert knn.knn(spark.createDataFrame([], schema), knn.divisible(1)).count() == 0
    one = spark.createDataFrame([(0, [1.0])], schema)
    assert knn.knn(one, knn.divisible(1)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], schema)
    assert {tuple(r) for r in knn.knn(two, knn.divisible(2)).collect()} == brute_top([(0, [1.0]), (1, [2.0]), (2, [2.0])], 2, 5)


# BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rows = texts(5, 40) + ["a<|endoftext|>b", "  a  b\n\n c 　d", "'s don't I'LL", "a" * 3000, "ab" * 900 + "!!", "日本 語 x", "😀😁 a", "x\x85 y", "\x1c z"]
    df = documents(spark, rows, False).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(df, vocabulary()), vocabulary()).collect()
    assert sorted(out) == sorted(bpe.encode(df, vocabulary(), decoded="decoded").select(*out[0].__fields__).collect())
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id] or ""
        assert r.ids == library.encode(text, add_special_tokens=False).ids and r.decoded == text and r["size"] == 1
    assert bpe.encode(empty(spark), vocabulary()).count() == 0


def test_forced_boundaries_lie_in_no_token():
    c = bpe.codec(vocabulary())
    assert not any(not c.inside[a, b] for t in c.id_of for a, b in zip(t, t[1:]))
    assert c.decode_all(np.array([int(c.byte_ids[0xC3])]))[0].tobytes() == b"\xc3"
    broken = pa.array([[int(c.byte_ids[0xC3])], None, [], [int(c.byte_ids[0x41])]], pa.list_(pa.int32()))
    assert bpe._decoded(c, broken).to_pylist() == ["�", "", "", "A"]
    with pytest.raises(ValueError):
        bpe._decoded(c, pa.array([[len(c.lengths)]], pa.list_(pa.int32())))


def test_runs_equal_single_texts(monkeypatch):
    """Batches cut into runs and very long texts into parts give what the library gives for each text."""
    from tokenizers import Tokenizer

    library, c = Tokenizer.from_file(vocabulary()), bpe.Codec(vocabulary())
    rng = random.Random(1)
    white = [" ", "  ", "\n", "\t ", "\u00a0", "\u3000 ", "\u2003", " \u0085", "\u202f\n", "\x1c ", "\x7f "]
    word = ["alpha", "Ünïcödé", "日本", "it's", "!!", "x1y", "é", "…", "<|endoftext|>", "😀", "don't", "42"]
    rows = ["".join(rng.choice(word) + rng.choice(white) for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["", "word " * 5000, "日本" * 3000]
    for size in (1 << 20, 200):
        monkeypatch.setattr(bpe, "RUN_BYTES", size)
        got = bpe._encoded(c, pa.array([*rows, None]))
        want = [library.encode(t, add_special_tokens=False).ids for t in rows]
        assert got.to_pylist() == [*want, []]
        assert bpe._decoded(c, got).to_pylist() == [*(library.decode(ids, skip_special_tokens=False) for ids in want), ""]
    alphabet = [chr(x) for x in [*range(0x250), 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x200B, 0x4E2D, 0x1F600, 0x301, 0x660, 0xB2]] + word + white
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    assert bpe._encoded(c, pa.array(mixed, pa.string())).to_pylist() == [e.ids for e in library.encode_batch(mixed, add_special_tokens=False)]
    # Should two fragments ever have one hash, each is encoded by itself.
    monkeypatch.setattr(bpe.textnp, "span_hashes", lambda data, begin, end, values: np.zeros(len(begin), np.uint64))
    assert bpe._encoded(c, pa.array(rows[:20])).to_pylist() == want[:20]


# Classifiers


def test_quality_network(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 150))) + "."
    bad = lambda: " ".join(rng.choice(["@@", "##", "%%"]) + rng.choice(WORDS).upper() for _ in range(rng.randrange(20, 150)))
    rows = [(good() if i % 3 else bad()) for i in range(300)] + [None, "", "x" * 200_000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(7, None), (None, 1), (9999, 1)], "doc_id bigint, quality int")
    df = documents(spark, rows, False)
    net = bytecnn.fit(df, labels, lambda key: id_remainder(key, 4) != 2)
    got = bytecnn.score(df, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 3 > 0) for r in held]) > 0.9
    assert bytecnn.score(empty(spark), net).count() == 0
    none = bytecnn.fit(df, labels.where("quality = 1"), lambda key: F.lit(True))
    assert bytecnn.score(df, none).agg(F.min("score")).first()[0] > 0.9


def naive_quality(net, text: bytes) -> float:
    """The network by its definition, place by place and chunk by chunk."""
    data = text + b"\0" * (bytecnn.WIDTH - len(text))
    places = range(len(data) - bytecnn.WIDTH + 1)
    act = [[sum(float(net.taps[k, data[p + k], f]) for k in range(bytecnn.WIDTH)) for f in range(bytecnn.FILTERS)] for p in places]
    blocks = [act[i : i + bytecnn.BLOCK] for i in range(0, len(act), bytecnn.BLOCK)]
    chunks = [a + b for a, b in zip(blocks, blocks[1:])] or blocks
    pooled = [[max(0.0, max(row[f] for row in c) + float(net.bias[f])) for f in range(bytecnn.FILTERS)] for c in chunks]
    columns = list(zip(*pooled))
    x = [sum(c) / len(c) for c in columns] + [max(c) for c in columns] + [min(c) for c in columns]
    x.append(np.log2(min(max(len(data), bytecnn.WIDTH), bytecnn.CHUNK) / bytecnn.CHUNK))
    hidden = [max(0.0, sum(v * float(net.w1[i, j]) for i, v in enumerate(x)) + float(net.b1[j])) for j in range(bytecnn.HIDDEN)]
    z = sum(h * float(net.w2[j]) for j, h in enumerate(hidden)) + float(net.b2[0])
    return 1 / (1 + np.exp(-z))


def small_network():
    rng = np.random.default_rng(5)
    texts_ = [bytes(rng.integers(97, 110 if i % 2 else 123, rng.integers(1, 1500)).astype(np.uint8)) for i in range(24)]
    return texts_, bytecnn.train(texts_, np.arange(24) % 2)


def test_network_equals_naive_convolution():
    """Every chunk of the whole text counts, across the pieces in which a long text is convolved."""
    texts_, net = small_network()
    for text in [b"", b"a", b"abcd", b"abcde", *texts_[:6], b"xy" * 9000]:
        got = net.probability(net.features(np.frombuffer(text, np.uint8))[None])[0]
        assert got == pytest.approx(naive_quality(net, text), abs=1e-4)


def test_gradients_are_those_of_the_loss():
    texts_, net = small_network()
    labels = (np.arange(24) % 2).astype(np.float32)
    docs = [bytecnn._blocks(t) for t in texts_]

    def loss() -> float:
        p = net.probability(np.stack([net.features(np.frombuffer(t, np.uint8)) for t in texts_]))
        return float(-np.mean(np.where(labels == 1, np.log(p), np.log(1 - p))))

    grads = bytecnn._gradients(net, docs, labels)
    for name, at in (("w2", (3,)), ("b1", (2,)), ("bias", (4,)), ("w1", (5, 1)), ("taps", (2, 100, 3)), ("taps", (0, 98, 7))):
        value = getattr(net, name)
        old, step = value[at].copy(), 1e-2
        value[at] = old + step
        up = loss()
        value[at] = old - step
        down = loss()
        value[at] = old
        assert float(grads[name][at]) == pytest.approx((up - down) / (2 * step), rel=0.2, abs=2e-4)


def test_toxicity(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        if i % 8 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "Nasty", "rotten"]))
        rows.append(" ".join(w))
    rows += [None, "", "vile " * 50_000]
    df = documents(spark, rows, False)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 600, 2)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    weights = toxicity.fit(df, labels, lambda key: id_remainder(key, 5) != 0)
    assert weights.bias < 0 < len(weights.feature)
    got = {r.doc_id: r.Score for r in toxicity.score(df, weights, name="Score").collect()}
    assert all(got[i] >= 0.5 for i in range(0, 600, 8)) and got[602] >= 0.5
    assert all(got[i] < 0.5 for i in range(600) if i % 8) and got[600] < 0.5 and got[601] < 0.5
    assert toxicity.score(empty(spark), weights, name="p").count() == 0
    none = toxicity.fit(df, labels.where("toxic = 0"), lambda key: F.lit(True))
    assert toxicity.score(df, none, name="p").agg(F.max("p")).first()[0] < 0.5


def naive_toxicity(weights, text: str | None) -> float:
    """The bias and the weight of each distinct word and stem."""
    import re

    by = dict(zip(weights.feature.tolist(), weights.weight.tolist()))
    seen = set()
    for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower()):
        data = np.frombuffer(w, np.uint8)
        for k in (len(w), *(k for k in toxicity.STEMS if k < len(w))):
            h = int(textnp.span_hashes(data, np.array([0]), np.array([k]))[0] >> np.uint64(32))
            seen.add(h if k == len(w) else h ^ 0x9E3779B9)
    return 1 / (1 + np.exp(-(weights.bias + sum(by.get(h, 0.0) for h in seen))))


def test_toxicity_equals_naive_sums(spark):
    rows = texts(8, 50) + ["vile vileness VILE", "x " * 70_000 + "vile", "é vilé"]
    vocabulary_ = sorted({h for t in rows for _, _, hs, _ in toxicity.features(*textnp.utf8(pa.array([t], pa.string()))) for h in hs.tolist()})
    rng = np.random.default_rng(0)
    chosen = np.array(vocabulary_, np.uint32)[rng.random(len(vocabulary_)) < 0.3]
    weights = toxicity.Weights(chosen, rng.normal(0, 1, len(chosen)), -0.3)
    got = {r.doc_id: r.p for r in toxicity.score(documents(spark, rows, False), weights, name="p").collect()}
    assert got == pytest.approx({i: naive_toxicity(weights, t) for i, t in enumerate(rows)})


def test_classifiers_fit_on_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    nothing, all_ids = empty(spark), lambda key: F.lit(True)
    for docs in (nothing, documents(spark)):
        weights = toxicity.fit(docs, labels, all_ids)
        net = bytecnn.fit(docs, labels, all_ids)
        assert toxicity.score(documents(spark), weights, name="p").agg(F.max("p")).first()[0] < 1e-9
        assert {r.p for r in bytecnn.score(documents(spark), net, name="p").collect()} == {0.5}
    known = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id bigint, toxic int, quality int")
    assert toxicity.fit(nothing, known, all_ids).bias == -30.0
    assert bytecnn.fit(nothing, known, all_ids).constant == 0.5


# Sharding


def test_sharding(spark):
    df = documents(spark, texts(6, 900))
    got = sharding.place_rows(df, shards=8).collect()
    assert len(got) == df.count()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    load, places = Counter(), defaultdict(list)
    for r in got:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and set(places) == set(range(8))
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    assert sharding.place_rows(empty(spark)).count() == 0


def test_map_versions(spark, tmp_path):
    rng = random.Random(1)
    weight = [rng.randrange(1, 100) for _ in range(2000)]
    old = sharding.first_map(2000, 10)
    balanced = sharding.rebalance(old, weight, 10)
    heavier = [w * (3 if balanced[s] == 4 else 1) for s, w in enumerate(weight)]
    new = sharding.rebalance(balanced, heavier, 10)
    load = Counter()
    for s, shard in enumerate(new):
        load[shard] += heavier[s]
    assert max(load.values()) - min(load.values()) <= 2
    assert sum(a != b for a, b in zip(balanced, new)) < 1000
    path = f"file://{tmp_path}/map"
    for version, shard_of in enumerate([old, balanced, new]):
        sharding.append_map(spark, path, version, shard_of)
        assert sharding.last_map(spark, path) == (version, shard_of)
    with pytest.raises(Exception, match="already exists"):
        sharding.append_map(spark, path, 1, old)
    with pytest.raises(ValueError):
        sharding.next_map(spark, path, weight[:-1], 10)


def test_sharding_goes_on_from_its_map(spark, tmp_path):
    """A second run edits the last version: old rows stay where they are but for the slots that were moved."""
    path = f"file://{tmp_path}/map"
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(1, 400)) for i in range(900)]
    more = rows + [(i, "y" * rng.randrange(1, 4000)) for i in range(900, 1100)]
    schema = "doc_id bigint, text string"
    one = {r.doc_id: r for r in sharding.place_rows(spark.createDataFrame(rows, schema), 8, map_path=path).collect()}
    versions = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "map").glob("*/*.parquet")}
    two = {r.doc_id: r for r in sharding.place_rows(spark.createDataFrame(more, schema), 8, map_path=path).collect()}
    again = {r.doc_id: r for r in sharding.place_rows(spark.createDataFrame(more, schema), 8, map_path=path).collect()}
    assert {r.map_version for r in one.values()} == {1} and {r.map_version for r in two.values()} == {2}
    assert versions.items() <= {p.name: p.stat().st_mtime_ns for p in (tmp_path / "map").glob("*/*.parquet")}.items()
    stayed = sum(one[i].shard == two[i].shard for i in one)
    assert 0.5 * len(one) < stayed < len(one)
    assert sum(two[i].shard == again[i].shard for i in two) > 0.95 * len(two)
    load = Counter()
    for r in two.values():
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())


def test_sharding_spreads_equal_rows_and_takes_null_ids(spark):
    rows = [(7, "same text")] * 5000 + [(None, "a"), (None, None), (None, None), (8, "b")]
    got = sharding.place_rows(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, slots=256).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t or "") + 16) for i, t in rows)
    load, places = Counter(r.shard for r in got), defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert max(load.values()) < 1.2 * len(rows) / 4
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
