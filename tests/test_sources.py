"""Sources and sinks: raw and strict reading, buffers in memory, profiles, and files that are written whole or not at all."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import quality
from wavemill.sources import adapters, wav


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def riff(*chunks: bytes) -> bytes:
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def fmt(channels=2, rate=48000, tag=1, bits=16) -> bytes:
    return chunk(b"fmt ", struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits))


def test_strict_reader():
    data = np.arange(12, dtype="<i2").tobytes()
    raw = riff(fmt(2, 44100), chunk(b"data", data), chunk(b"LIST", b"abc"), fmt(3, 22050), chunk(b"data", b"\1\0"))
    got = wav.probe_strict(raw)
    assert (got.channels, got.rate, got.bits, got.data) == (3, 22050, 16, data)  # the last format, the first data
    assert wav.probe(raw).channels == 2
    bad = [
        b"", b"RIFF", riff(), riff(fmt()), riff(chunk(b"data", data)), riff(fmt(tag=3, bits=32), chunk(b"data", data)), riff(fmt(), chunk(b"data", b"")),
        riff(fmt(), chunk(b"data", data[:-2])), riff(fmt(), chunk(b"data", data))[:-4], riff(chunk(b"fmt ", b"short"), chunk(b"data", data)),
        riff(fmt(), chunk(b"data", data), fmt(tag=3, bits=32)),
    ]
    for raw in bad:
        with pytest.raises(ValueError):
            wav.probe_strict(raw)


@pytest.mark.parametrize("layout, encode", [
    ("s16le", lambda x: x.astype("<i2").tobytes()),
    ("s24le", lambda x: b"".join(int(v * 256).to_bytes(3, "little", signed=True) for v in x.ravel())),
    ("f32le", lambda x: (x / 32768).astype("<f4").tobytes()),
])
def test_raw_files(spark, tmp_path, layout, encode):
    x = np.random.default_rng(1).integers(-32768, 32768, (5000, 2))
    (tmp_path / "a.pcm").write_bytes(encode(x))
    (tmp_path / "b.pcm").write_bytes(b"123")
    rows = wav.read_raw(spark, f"file://{tmp_path}", 48000, 2, layout)
    assert rows.where("error is not null").count() == 1
    got = {(r.channel, r.frame): r["sample"] for r in wav.samples(rows).collect()}
    assert got == {(c, k): int(x[k, c]) for k in range(5000) for c in (0, 1)}


def test_strict_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(riff(fmt(), chunk(b"data", b"\1\0\2\0"), fmt(1)))
    got = wav.read_wav(spark, f"file://{tmp_path}", strict=True).collect()
    assert [(r.channels, list(r.samples)) for r in got] == [(1, [1, 2])]


def test_buffers(spark):
    x = np.array([[1, -2, 3], [4, 5, -32768]])
    forms = [
        ("rows", x.tolist()), ("rows", (x / 32768).tolist()), ("channel-major", x.astype("<i2").tobytes()), ("interleaved", x.T.astype("<i2").tobytes()),
    ]
    for form, data in forms:
        rows = wav.samples(adapters.buffer(spark, data, 2, form))
        assert {(r.channel, r.frame): r["sample"] for r in rows.collect()} == {(c, k): int(x[c, k]) for c in (0, 1) for k in range(3)}
    for form, data in (("rows", [[1], [2, 3]]), ("rows", [[0.3], [0.1]]), ("rows", [[40000], [1]]), ("interleaved", b"123"), ("interleaved", b""), ("other", b"")):
        with pytest.raises(ValueError):
            adapters.buffer(spark, data, 2, form)


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.createDataFrame([(f"f{i}.bin", bytes([i]) * i) for i in range(9)], "name string, body binary").repartition(3)
    assert wav.write_files(rows, str(folder)) == 9
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {f"f{i}.bin": bytes([i]) * i for i in range(9)}
    failing = rows.withColumn("body", F.when(F.col("name") == "f8.bin", F.raise_error(F.lit("refused")).cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="refused"):
        wav.write_files(failing, str(folder))
    assert (folder / "f3.bin").read_bytes() == b"\3\3\3" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_profiles_from_files(spark, tmp_path):
    good = [{"profile": "a", "generation": 1, "channels": 2, "rate": 48000}, {"profile": "b", "generation": 2, "channels": 6, "rate": 44100}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, good)))
    assert [r.asDict() for r in quality.read_profiles(spark, f"file://{tmp_path}/p.jsonl").orderBy("profile").collect()] == good
    for bad in ({"profile": "a"}, good[0] | {"rate": 0}, good[0] | {"channels": "two"}):
        (tmp_path / "bad.jsonl").write_text(json.dumps(bad))
        with pytest.raises(Exception):
            quality.read_profiles(spark, f"file://{tmp_path}/bad.jsonl").collect()
    text = spark.range(1).select(quality.profile_description(F.lit(1), F.lit(6), F.lit(48000), F.lit("5.1"))).first()[0]
    assert text == "g1-6ch-48000-5.1"
