"""Codebooks, setups, floors, residues, packets and sessions against brute force and round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import books, codec, container, entropy, packets, posts, setup, spectral
from wavemill.streaming import sessions

RNG = np.random.default_rng(7)


def test_bits_by_one_walk():
    rng, out, values = random.Random(1), books.Bits(), []
    for _ in range(500):
        n = rng.randrange(0, 33)
        values.append((rng.getrandbits(n) if n else 0, n))
        assert out.field(n, values[-1][0]) == values[-1][0]
    back = books.Bits(out.tobytes())
    assert [back.field(n) for _, n in values] == [v for v, _ in values]
    assert back.left < 8
    with pytest.raises(EOFError):
        back.field(9)
    for value, bits in ((4, 2), (-1, 3), (0, 33)):
        with pytest.raises(ValueError):
            books.Bits().field(bits, value)


def test_codewords_are_prefix_free_and_in_order():
    for lengths in ([2, 2, 2, 2], [1, 2, 3, 3], [3, 1, 3, 2], [0, 2, 0, 2, 1]):
        codes = [(n, c) for n, c in zip(lengths, entropy.codewords(lengths)) if c is not None]
        text = [format(c, f"0{n}b") for n, c in codes]
        assert not any(a != b and b.startswith(a) for a in text for b in text)
    with pytest.raises(ValueError):
        entropy.codewords([1, 1, 1])
    with pytest.raises(ValueError):
        entropy.codewords([2, 2, 2])


@pytest.mark.parametrize(
    "book",
    [
        books.Book(1, (2, 2, 2, 2)),
        books.Book(1, (1, 2, 3, 4, 4)),
        books.Book(2, (0, 3, 3, 0, 3, 3, 3, 3, 3, 3)),
        books.Book(3, tuple(entropy.balanced_lengths(27)), (0, 2, 5), -1.5, 0.25, True),
        books.Book(1, (1,)),
    ],
)
def test_stored_books(book):
    assert books.parse_book(books.pack_book(book)) == book


def test_packed_floats():
    for x in (0.0, 1.0, -1.0, 0.25, -361.0 * 9, 1e-6, 1234567.0):
        assert books.unpack_float(books.pack_float(x)) == pytest.approx(x, rel=1e-6)


def test_lattice_vectors_and_nearest_entries():
    book = books.Book(2, (3, 0, 3, 3, 3, 3, 3, 3, 3), (0, 1, 2), -1.0, 1.0)
    for e in range(9):
        assert book.vectors[e].tolist() == entropy.lattice(e, 2, 3, -1.0, 1.0, [0, 1, 2])
    points = RNG.normal(0, 1, (50, 2))
    for p, got in zip(points, book.nearest(points)):
        far = [(float(((p - book.vectors[e]) ** 2).sum()), e) for e in range(9) if book.lengths[e]]
        assert got == min(far)[1]
    assert book.nearest_used(1) == 0 and book.nearest_used(8) == 8


@pytest.mark.parametrize("channels", [1, 2, 5])
def test_setups_come_back(channels):
    made, own = setup.profile(channels)
    raw = setup.pack(made, channels)
    back = setup.parse(raw, channels)
    assert back.pop("clean") and back == made
    assert not setup.parse(raw + b"\1", channels)["clean"]
    setup.check(made, len(own))
    for cut in (0, 1, len(raw) // 2, len(raw) - 3):
        with pytest.raises((EOFError, ValueError)):
            setup.parse(raw[:cut], channels)
    for part, name in (("modes", "mapping"), ("residues", "classbook")):
        broken = setup.parse(raw, channels)
        broken[part][0][name] = 60
        with pytest.raises(ValueError):
            setup.check(broken, len(own))


def test_setup_with_submaps():
    made, _ = setup.profile(4)
    made["mappings"][0] |= {"floors": [0, 1], "residues": [0, 1], "mux": [0, 1, 1, 0], "coupling": [(0, 3), (1, 2)]}
    back = setup.parse(setup.pack(made, 4), 4)
    assert back["mappings"][0] == made["mappings"][0]
    assert [setup.submap_of(back["mappings"][0], c) for c in range(6)] == [0, 1, 1, 0, 0, 0]
    assert setup.propagate([False, False, True, False], [(0, 3), (1, 2)]) == [False, True, True, False]
    with pytest.raises(ValueError):
        setup.propagate([True], [(0, 1)])


def test_floor_wrap_covers_all_heights():
    places = [0, 64, 10, 50, 30, 5]
    for _ in range(300):
        y = RNG.integers(0, 128, 6).tolist()
        stored = posts.wrap(y, places, 128)
        back, used = posts.unwrap(stored, places, 128)
        assert back == y and min(stored) >= 0 and max(stored) < 128
        assert all(u or not s for u, s in zip(used[2:], stored[2:]))


def test_best_choice_is_the_best_of_all():
    own = [books.Book(1, (1, 2, 2)), books.Book(1, tuple(entropy.balanced_lengths(40))), books.Book(1, (0, 0, 0, 0, 0, 1, 1))]
    kind = {"dim": 3, "bits": 2, "master": 0, "books": [-1, 0, 1, 2]}

    def score(choice: int, heights: list[int]) -> int:
        total = 0
        for j, h in enumerate(heights):
            b = kind["books"][choice >> 2 * j & 3]
            if b < 0:
                if h:
                    return -1
                total += 1
            else:
                used = [i for i, n in enumerate(own[b].lengths) if n]
                total += 2 if h in used else int(any(abs(h - u) <= 2 for u in used))
        return total

    for _ in range(100):
        heights = RNG.integers(0, 45, 3).tolist()
        assert packets.best_choice(kind, heights, own) == max(range(64), key=lambda c: (score(c, heights), -c))


@pytest.mark.parametrize("channels, block, mode", [(1, 128, 0), (2, 256, 0), (2, 2048, 1), (6, 256, 1)])
def test_packets_come_back(channels, block, mode):
    made, own = setup.profile(channels, block, block)
    n, floor = block // 2, made["floors"][mode]
    for seed in range(6):
        rng = np.random.default_rng(seed)
        heights = [None if rng.random() < 0.25 else rng.integers(120, 250, 2 + len(floor["inner"])).tolist() for _ in range(channels)]
        spectra = rng.normal(0, 0.05, (channels, n))
        data, rows = packets.pack_block(made, own, mode, heights, spectra)
        got = packets.parse_block(data, made, own, channels, (block, block))
        assert got["mode"] == mode and got["whole"] and got["heights"] == heights and (got["residues"] == rows).all()
        silent = [c for c in range(channels) if heights[c] is None]
        assert not got["spectra"][silent].any()
        loud = [c for c in range(channels) if heights[c] is not None]
        step = packets.amplitude(got["levels"][loud])
        assert (np.abs(got["spectra"][loud] - spectra[loud]) <= step / 2 + 1e-9).all()
        short = packets.parse_block(data[: len(data) * 3 // 4], made, own, channels, (block, block)) if loud else None
        assert short is None or not short["whole"]
    with pytest.raises(ValueError):
        packets.parse_block(b"", made, own, channels, (block, block))


def test_silent_packets_are_one_byte():
    made, own = setup.profile(2, 128, 128)
    data, rows = packets.pack_block(made, own, 0, [None, None], RNG.normal(0, 1, (2, 64)))
    assert len(data) == 1 and not rows.any() and packets.silent(made["residues"][0])


def joint_by_bins(x, levels, peaks, used):
    """The joint quantizer bin by bin and partition by partition."""
    n = x.shape[1]
    size, third = (8 if n == 128 else 32), n // 3
    out, before = np.zeros((2, n), np.int64), -1.0
    f32 = np.float32
    for begin in range(0, n * 3 // 4, size):
        count = min(size, n - begin)
        r, e, flag, fl = np.zeros((2, count), f32), np.zeros((2, count), f32), np.zeros((2, count), int), np.full((2, count), 1e-10, f32)
        for c in (0, 1):
            if not used[c]:
                continue
            for k in range(count):
                i = begin + k
                share = 1.0 if begin >= third else ((k + 1) / count if third - begin <= count else 0.0)
                f = f32(10 ** (7 * (levels[c, i] - 255) / 256))
                v = f32(x[c, i])
                r[c, k] = v / f
                limit = max(2.5 * share - peaks[c, i], 0)
                flag[c, k] = 1 if abs(r[c, k]) >= limit else (0 if abs(r[c, k]) < 0.5 * share else -1)
                e[c, k], fl[c, k] = np.sign(v) * v * v, f * f
                out[c, i] = np.rint(r[c, k])
        if begin < n * 35 // 64:
            strong = [k for k in range(count) if any(v < -0.5 or v >= 0.5 for v in r[:, k])]
            if strong:
                turned = sum(e[0, k] * e[1, k] < 0 for k in strong)
                now = sum(abs(abs(float(r[0, k])) - abs(float(r[1, k]))) for k in strong) / len(strong)
                mean, before = ((now + before) / 2 if before > 0 else now), now
                for k in range(count):
                    if mean > 1 and -1 in flag[:, k]:
                        flag[0, k] = 1
                    if turned / len(strong) >= 0.34 and e[0, k] * e[1, k] < 0 and -1 in flag[:, k]:
                        flag[0, k] = 1
            else:
                before = -1.0
        for k in range(count):
            i = begin + k
            if 1 in flag[:, k]:
                a, b = int(out[0, i]), int(out[1, i])
                m = a if abs(a) > abs(b) else b
                d = a - b if m > 0 else b - a
                out[:, i] = (-m, -d) if d >= 2 * abs(m) else (m, d)
            else:
                a, b = float(e[0, k]), float(e[1, k])
                p, q, back = abs(a) * 0.94, abs(b) * 0.94, 0.18 if i < third else 0.12
                if (a > 0) == (b > 0):
                    s = (p + q) * (1 if a > 0 else -1)
                else:
                    s = (max(p, q) - min(p, q) * back) * (1 if (a if p > q else b) > 0 else -1)
                out[:, i] = np.sign(s) * np.rint(np.sqrt(abs(s) / float(fl[0, k] + fl[1, k]))), 0
    return out


@pytest.mark.parametrize("n", [128, 1024])
def test_joint_stereo_equals_its_rule(n):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.normal(0, 0.02, (2, n)) * (rng.random((2, n)) < 0.7)
        x[1] = np.where(rng.random(n) < 0.5, x[0] * rng.normal(0, 1), x[1])
        levels, peaks = rng.integers(180, 215, (2, n)), np.where(rng.random((2, n)) < 0.1, 2.0, 0.0)
        used = [True, seed != 3]
        got, want = packets.joint_stereo(x, levels, peaks, used), joint_by_bins(x, levels, peaks, used)
        assert (got != want).mean() < 0.002  # roundings at halves


def test_transforms_by_fourier():
    for n in (64, 256):
        x, c = RNG.normal(0, 1, (3, n)), RNG.normal(0, 1, (3, n // 2))
        assert np.allclose(spectral.lapped(x), x @ spectral.cosine_basis(n))
        assert np.allclose(spectral.unlapped(c), c @ spectral.cosine_basis(n).T)


def test_lpc_tail_by_solving(spark):
    """The prediction of a stream from the normal equations, not by recursion."""
    k = np.arange(400)
    x = np.rint(9000 * np.sin(0.21 * k) + 4000 * np.sin(0.5 * k + 1)).astype(int)
    rows = spark.createDataFrame([(1, int(i) * 3, int(v)) for i, v in zip(k, x)], "stream bigint, i bigint, sample int")
    got = [r.y for r in spectral.lpc_tail(rows, 8, 12).orderBy("k").collect()]
    s = x / 32768.0
    r = np.array([s[lag:] @ s[: len(s) - lag] for lag in range(9)])
    matrix = r[np.abs(np.arange(8)[:, None] - np.arange(8)[None, :])] + np.eye(8) * r[0] * 1e-10
    taps = np.linalg.solve(matrix, -r[1:]) * 0.99 ** np.arange(1, 9)
    work = list(s)
    for _ in range(12):
        work.append(-sum(t * work[-1 - j] for j, t in enumerate(taps)))
    assert got == pytest.approx(work[-12:], abs=2e-3)
    late = spectral.lpc_tail(rows, 8, 12, window=200).orderBy("k").collect()
    assert [r.y for r in late] != got


def test_lpc_prime_is_the_tail_of_the_stream_backwards(spark):
    k = np.arange(300)
    x = np.rint(9000 * np.sin(0.21 * k)).astype(int)
    rows = spark.createDataFrame([(1, int(i), int(v)) for i, v in enumerate(x)], "stream bigint, i bigint, sample int")
    turned = spark.createDataFrame([(1, int(i), int(v)) for i, v in enumerate(x[::-1])], "stream bigint, i bigint, sample int")
    got = [r.y for r in spectral.lpc_prime(rows, 8, 10).orderBy("k").collect()]
    assert got == [r.y for r in spectral.lpc_tail(turned, 8, 10).orderBy(F.desc("k")).collect()]


def test_split_fit_finds_the_knots_of_a_broken_line():
    x = [0, 63, 16, 48, 32, 8, 24, 40, 56]
    knots = {0: 200, 16: 700, 48: 100, 63: 500}
    levels = np.rint(np.interp(np.arange(64), list(knots), list(knots.values()))).astype(int)
    got = dict(zip(x, posts.split_fit(levels, x)))
    assert all(got[p][1] and abs(got[p][0] - y) < 25 for p, y in knots.items())
    flat = posts.split_fit(np.full(64, 321), x)
    assert [n for _, n in flat] == [True, True] + [False] * 7 and {h for h, _ in flat} == {321}
    for seed in range(20):
        levels = np.clip(np.cumsum(np.random.default_rng(seed).normal(0, 30, 64)) + 500, 0, 1023).astype(int)
        fit = posts.split_fit(levels, x)
        order = sorted(range(len(x)), key=lambda i: x[i])
        drawn = np.interp(np.arange(64), [x[i] for i in order], [fit[i][0] for i in order])
        whole = posts.split_fit(levels, x[:2])
        line = np.interp(np.arange(64), [0, 63], [whole[0][0], whole[1][0]])
        assert ((levels - drawn) ** 2).sum() <= ((levels - line) ** 2).sum() * 1.02


def tone(frames: int) -> np.ndarray:
    k = np.arange(frames)
    x = np.stack([6000 * np.sin(0.03 * k), 5000 * np.sin(0.05 * k + 1)], axis=1)
    x[frames // 2 : frames // 2 + 40] += 15000 * RNG.normal(0, 1, (min(40, frames - frames // 2), 2))
    return np.clip(np.rint(x), -32768, 32767).astype(np.int64)


@pytest.mark.parametrize("frames", [1, 63, 64, 700, 9000])
def test_encoding_sessions_do_not_depend_on_chunks(frames):
    x = tone(frames).ravel()
    outs = []
    for size in (2 * 50, 2 * 3001, 2 * frames):
        encoder, out = sessions.Encoder(2, 64.0, 0), []
        for seq, at in enumerate(range(0, len(x), size)):
            out += encoder.push(seq, x[at : at + size])
            assert encoder.held.shape[1] <= 2 * codec.LONG + size // 2
            encoder = sessions.Encoder(2, 64.0, 0, encoder.state)
        outs.append(out + encoder.finish())
    assert outs[0] == outs[1] == outs[2]
    decoder = sessions.Session(2, 64.0)
    parts = [decoder.push(seq, body, frames)[1] for seq, _, body in outs[0]] + [decoder.finish(frames)[1]]
    assert np.concatenate(parts, axis=1).shape == (2, frames)


def test_encoding_sessions_refuse_disorder():
    encoder = sessions.Encoder(2, 32.0)
    encoder.push(0, np.zeros(20))
    for seq, samples in ((5, np.zeros(2)), (1, np.zeros(3))):
        with pytest.raises(ValueError):
            encoder.push(seq, samples)
    with pytest.raises(ValueError, match="needed"):
        encoder.finish()
    done = sessions.Encoder(1, 32.0, 0)
    done.push(0, np.ones(10))
    done.finish()
    with pytest.raises(ValueError, match="ended"):
        done.push(1, np.ones(2))


def test_sessions_agree_with_the_batch_encoder(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["q70_chunk_invariance"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.chunks_130 and r.chunks_1999 for r in rows)


def test_container_sessions():
    body = b"".join(len(p).to_bytes(2, "little") + p for p in (b"setup", b"", b"x" * 300))
    header = bytearray(container.HEADER)
    at = sum(n for _, n in container.FIELDS[: [f for f, _ in container.FIELDS].index("seek_size")])
    header[at : at + 4] = (4).to_bytes(4, "little")
    raw = container.riff(b"WAVE", [(b"JUNK", b"odd"), (b"fmt ", bytes(header)), (b"data", b"seek" + body)])
    for size in (1, 7, len(raw)):
        reader, out = sessions.Reader(), []
        for seq, k in enumerate(range(0, len(raw), size)):
            out += reader.push(seq, raw[k : k + size])
            reader = sessions.Reader(reader.state)
        reader.finish()
        assert out == [(0, b"setup"), (1, b""), (2, b"x" * 300)] and reader.header == bytes(header)
    short = sessions.Reader()
    short.push(0, raw[:-5])
    with pytest.raises(ValueError, match="early"):
        short.finish()
    with pytest.raises(ValueError, match="not a container"):
        sessions.Reader().push(0, b"RIFFxxxxAVI other")
    with pytest.raises(ValueError, match="due"):
        sessions.Reader().push(3, raw)
