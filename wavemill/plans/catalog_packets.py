"""Queries over codebooks, setups, floors, residues and block packets, each held against SQL over what went in."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wavemill.functions import numeric as N
from wavemill.operators import books, codec, container, entropy, floors, framing, packets, posts, quality, schedule, setup, spectral
from wavemill.plans.catalog import (
    ACCOUNT, FINE, HEADER_VALUES, LEVELS, LENGTHS, MONO, PACKETS, PCM, RESIDUE, _accounts, _as_stream, _classes, _rows64, query,
)
from wavemill.plans.runtime import scratch, table
from wavemill.sources import adapters as A
from wavemill.streaming import overlap, sessions

WORDS = books.Book(1, tuple(LENGTHS))
SHORTER, LONGER = min(LENGTHS), max(LENGTHS)
WORD_LENGTH = f"CASE WHEN cls_word < {LENGTHS.count(SHORTER) if SHORTER < LONGER else 0} THEN {SHORTER} ELSE {LONGER} END"


@query(f"""WITH {MONO}, words AS (SELECT idx, part // 4 AS word, sum(cls * pow(8, 3 - part % 4))::BIGINT AS cls_word FROM classed GROUP BY idx, part // 4)
SELECT idx, word::INT AS word, cls_word::INT AS entry, sum({WORD_LENGTH}) OVER (PARTITION BY idx)::BIGINT AS bits FROM words""")
def q61_prefix_code(spark, sf_dir):
    """Class words through a prefix code and back, with the bits they take."""
    words = floors.class_word(_classes(spark, sf_dir), ("idx",), 8, 4)
    rows = words.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "cls_word"))), lambda e: e["cls_word"]).alias("s"))
    rows = rows.withColumn("c", books.coded(F.col("s"), WORDS))
    back = books.decoded(F.col("c.payload"), F.size("s"), WORDS)
    return rows.select("idx", F.posexplode(back).alias("word", "entry"), F.col("c.bits").alias("bits"))


SPIRAL = books.Book(3, tuple(entropy.balanced_lengths(125)), (4, 0, 7, 1, 9), -2.5, 0.75, True)


@query(f"""WITH e AS (SELECT p_partkey, p_partkey % 125 AS entry FROM part), d AS (
SELECT p_partkey, entry, [{', '.join(f"list_extract({list(SPIRAL.values)}, (entry // {5**k} % 5 + 1)::INT) * 0.75::DOUBLE - 2.5::DOUBLE" for k in range(3))}] AS d FROM e)
SELECT p_partkey, entry, d[1] AS a, d[1] + d[2] AS b, d[1] + d[2] + d[3] AS c FROM d""")
def q62_lattice_vector(spark, sf_dir):
    """Vectors of lattice entries, with running sums."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_partkey", F.lit(125)).alias("entry"))
    rows = rows.withColumn("v", books.vector_of(F.col("entry"), SPIRAL))
    return rows.select("p_partkey", "entry", *(F.element_at("v", k + 1).alias(n) for k, n in enumerate("abc")))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(str(r) for r in rows) + ")"


#: Channels of the setups that are written and read.
LAYOUTS = (1, 2, 6)


@query(f"""SELECT * FROM {_values([(c, *f) for c in LAYOUTS for f in setup.fields(setup.profile(c)[0])])} AS t(channels, section, nr, field, value)""")
def q63_setup_fields(spark, sf_dir):
    """Setups of our own profile, packed and parsed: every field."""
    out = None
    for channels in LAYOUTS:
        packed = spark.createDataFrame([(channels, setup.pack(setup.profile(channels)[0], channels))], "id bigint, setup binary")
        rows = setup.parsed_fields(packed, channels).withColumnRenamed("id", "channels")
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.col("channels").cast("int"), "section", "nr", "field", F.col("value").cast("int").alias("value"))


BOOKS = [*setup.profile(2)[1], SPIRAL, books.Book(1, (0, 2, 2, 0, 1))]


@query(f"""SELECT * FROM {_values([(i, e, n, b.dim, len(b.values)) for i, b in enumerate(BOOKS) for e, n in enumerate(b.lengths)])} AS t(book_id, entry, length, dim, n_values)""")
def q64_codebook_load(spark, sf_dir):
    """Stored codebooks, looked up by number, parsed: the length of every entry."""
    stored = spark.createDataFrame([(i, books.pack_book(b)) for i, b in enumerate(BOOKS)], "book_id int, body binary")
    wanted = spark.createDataFrame([(i,) for i in range(len(BOOKS))], "book_id int")

    @F.udf("struct<dim:int,n_values:int,lengths:array<int>>")
    def parsed(body):
        b = books.parse_book(bytes(body))
        return b.dim, len(b.values), list(b.lengths)

    rows = books.load_books(wanted, stored).select("book_id", parsed("body").alias("b"))
    return rows.select("book_id", F.posexplode("b.lengths").alias("entry", "length"), "b.dim", "b.n_values")


BLOCK = 128
FLOOR = setup.profile(1, BLOCK, BLOCK)[0]["floors"][0]
AT = setup.post_places(FLOOR)


def _blocks(spark, sf_dir, channels: int, heights):
    """Spectrum rows as blocks of one channel, or of two with successive rows, in units of residue; ``heights`` from an array of coefficients."""
    rows = _rows64(spark, sf_dir).select(
        F.floor(F.col("idx") / channels).alias("id"),
        F.pmod("idx", F.lit(channels)).cast("int").alias("c"),
        F.transform("x", lambda e: e / 0.0625).alias("s"),
        heights(F.col("x")).alias("h"),
    )
    # A pair lacks nothing but where its rows are not both there.
    each = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "s", "h"))).alias("e")).where(F.size("e") == channels)
    return each.select("id", F.transform("e", lambda e: e["s"]).alias("spectra"), F.transform("e", lambda e: e["h"]).alias("heights"))


def _level_heights(x):
    return F.array(*(N.multiplier_level(N.level(N.db(F.element_at(x, min(p, 63) + 1))), F.lit(1)).cast("int") for p in AT))


@query(f"""WITH {LEVELS} SELECT idx AS id, k::INT AS post, (level // 4)::INT AS height FROM levels JOIN {_values([(k, min(x, 63)) for k, x in enumerate(AT)])} AS p(k, x) ON bin = x""")
def q65_floor_body(spark, sf_dir):
    """Floor heights wrapped, stored through codebooks in packets, parsed and unwrapped."""
    got = packets.through_packets(_blocks(spark, sf_dir, 1, _level_heights), 1, BLOCK)
    return got.select("id", F.posexplode("back_heights").alias("post", "height"))


def _flat(x):
    """A floor of 1 everywhere, so that residues are what went in."""
    return F.array_repeat(F.lit(255), len(AT))


@query(f"WITH {RESIDUE} SELECT idx AS id, bin::INT AS bin, q FROM res")
def q66_residue_single(spark, sf_dir):
    """Residues of single channels as cascades of codebook vectors, and back."""
    got = packets.through_packets(_blocks(spark, sf_dir, 1, _flat), 1, BLOCK)
    return got.select("id", F.posexplode("back").alias("bin", "q"))


@query(f"""WITH {RESIDUE}, p AS (SELECT a.idx // 2 AS id, a.bin, a.q AS f, b.q AS s, CASE WHEN abs(a.q) > abs(b.q) THEN a.q ELSE b.q END AS m
FROM res a JOIN res b ON b.idx = a.idx + 1 AND b.bin = a.bin AND a.idx % 2 = 0)
SELECT id, bin::INT AS bin, m AS magnitude, CASE WHEN m > 0 THEN f - s ELSE s - f END AS angle FROM p""")
def q67_residue_pair(spark, sf_dir):
    """Residues of coupled pairs, interleaved, as cascades of codebook vectors, and back."""
    got = packets.through_packets(_blocks(spark, sf_dir, 2, _flat), 2, BLOCK)
    both = got.groupBy("id").agg(F.max_by("back", -F.col("channel")).alias("m"), F.max_by("back", "channel").alias("a"))
    each = both.select("id", F.posexplode(F.arrays_zip("m", "a")).alias("bin", "p"))
    return each.select("id", "bin", F.col("p.m").alias("magnitude"), F.col("p.a").alias("angle"))


PAIRED = [(0, 1), (2, 3), (1, 2)]


@query("""WITH f AS (SELECT p_partkey, p_partkey % 7 = 0 AS a, p_partkey % 5 = 0 AS b, p_partkey % 3 = 0 AS c, p_partkey % 2 = 0 AS d FROM part)
SELECT p_partkey, a OR b AS a, a OR b OR c OR d AS b, a OR b OR c OR d AS c, c OR d AS d FROM f""")
def q68_live_channels(spark, sf_dir):
    """Which channels are coded, as coupling makes either's floor count for both, pair after pair."""
    key = F.col("p_partkey")
    flags = [F.pmod(key, F.lit(n)) == 0 for n in (7, 5, 3, 2)]
    for m, a in PAIRED:
        flags[m] = flags[a] = flags[m] | flags[a]
    return table(spark, sf_dir, "part").select("p_partkey", *(f.alias(n) for f, n in zip(flags, "abcd")))


def _sample_chunks(spark, sf_dir, size: int) -> str:
    """The two channels interleaved in chunks of ``size`` frames, written for a stream to read; the last chunk ends it."""
    pcm = _as_stream(spark, sf_dir)
    # A channel that ends a frame early is carried on by silence.
    rows = pcm.groupBy("stream", "frame").pivot("channel", [0, 1]).agg(F.first("sample")).na.fill(0)
    rows = rows.withColumn("seq", F.floor(F.col("frame") / size))
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.array("0", "1").alias("s"))))
    chunks = rows.groupBy("stream", "seq").agg(F.flatten(F.transform(ordered, lambda e: e["s"])).alias("samples"))
    last = chunks.groupBy("stream").agg(F.max("seq").alias("last"))
    path = scratch(spark, "samples")
    chunks.join(last, "stream").select("stream", "seq", "samples", (F.col("seq") == F.col("last")).alias("eos")).repartition("stream").write.parquet(path)
    return path


@query(f"""WITH {PCM}, n AS (SELECT max(frame) AS m FROM pcm) SELECT channel, frame, sample FROM pcm
UNION ALL SELECT 1, m, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM pcm, n WHERE channel = 1 AND frame = m)""")
def q69_encode_session(spark, sf_dir):
    """Chunks of a stream through an encoding session and a decoding session: every sample back."""
    chunks = spark.readStream.schema(sessions.CHUNKS).parquet(_sample_chunks(spark, sf_dir, 700))
    coded = overlap.run_once(sessions.encode_session(chunks, 2, FINE, 0), scratch(spark, "packets"), scratch(spark, "log"))
    frames = coded.groupBy("stream").agg(F.max("frames").alias("frames"), F.max("seq").alias("last"))
    rows = coded.drop("frames", "mode").join(frames, "stream")
    path = scratch(spark, "packets")
    rows.select("stream", "seq", "payload", "frames", (F.col("seq") == F.col("last")).alias("eos")).repartition("stream").write.parquet(path)
    stream = spark.readStream.schema(sessions.PACKETS).parquet(path)
    done = overlap.run_once(sessions.decode_session(stream, 2, FINE), scratch(spark, "pcm"), scratch(spark, "log"))
    each = done.select("channel", "start", F.posexplode("samples").alias("pos", "x"))
    return each.select("channel", (F.col("start") + F.col("pos")).alias("frame"), N.half_away(F.col("x") * 32768.0).cast("int").alias("sample"))


@query()
def q70_chunk_invariance(spark, sf_dir):
    """Packets of an encoding session over chunks of two sizes and of the batch encoder: all the same, packet by packet."""
    out = codec.encode(_as_stream(spark, sf_dir), 2, least=0).select("seq", F.col("payload").alias("batch"))
    for size in (130, 1999):
        chunks = spark.readStream.schema(sessions.CHUNKS).parquet(_sample_chunks(spark, sf_dir, size))
        coded = overlap.run_once(sessions.encode_session(chunks, 2, least=0), scratch(spark, "packets"), scratch(spark, "log"))
        out = out.join(coded.select("seq", F.col("payload").alias(f"chunks_{size}")), "seq", "full")
    return out.select("seq", *((F.col("batch") == F.col(c)).alias(c) for c in out.columns[2:]), F.octet_length("batch").alias("bytes"))


@query(f"""WITH {PCM}, f AS (SELECT frame // 1000 AS block, frame, sample, channel FROM pcm WHERE frame < 4500)
SELECT block, channel, frame, (row_number() OVER (PARTITION BY block ORDER BY frame, channel) - 1)::INT AS place, sample FROM f""")
def q71_interleave(spark, sf_dir):
    """Frame-major order of channels, stopped at the declared count, in blocks of delivery."""
    rows = framing.interleave(_as_stream(spark, sf_dir), 4500).withColumn("block", framing.delivery_block(F.col("frame"), 1000))
    place = F.row_number().over(W.partitionBy("block").orderBy("frame", "channel")) - 1
    return rows.select("block", "channel", "frame", place.alias("place"), "sample")


@query(f"""WITH {ACCOUNT}, p AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS seq, size FROM packets)
SELECT stream, p.seq, p.size, a.data_size, a.frames AS total_frames FROM p JOIN account a USING (stream)""")
def q81_container_session(spark, sf_dir):
    """Containers that come in pieces of 40 bytes: every packet, and the header's fields."""
    accounts = _accounts(spark, sf_dir)
    values = {n: F.expr(v.replace("//", "div")) for n, v in HEADER_VALUES.items()}
    heads = accounts.select("stream", container.pack_header(**values).alias("header"))
    files = container.build_container(container.build_stream(A.packets(spark, sf_dir)).join(heads, "stream"))
    size = F.octet_length("file")
    cut = F.explode(F.sequence(F.lit(0), F.floor((size - 1) / 40))).alias("seq")
    pieces = files.select("stream", "file", cut).select(
        "stream", "seq", F.substring("file", (F.col("seq") * 40 + 1).cast("int"), F.lit(40)).alias("body"), (F.col("seq") == F.floor((size - 1) / 40)).alias("eos")
    )
    path = scratch(spark, "pieces")
    pieces.repartition("stream").write.parquet(path)
    stream = spark.readStream.schema(sessions.BYTES).parquet(path)
    got = overlap.run_once(sessions.read_session(stream), scratch(spark, "packets"), scratch(spark, "log"))
    got = got.withColumn("h", container.parse_header(F.col("header")))
    return got.select("stream", "seq", F.octet_length("payload").cast("bigint").alias("size"), "h.data_size", "h.total_frames")


@query(f"""WITH {PCM}, m AS (SELECT max(frame) + 1 AS n FROM pcm WHERE channel = 0), s AS (SELECT frame, sample FROM pcm WHERE channel = 0
UNION ALL SELECT k - 300 AS frame, k % 50 AS sample FROM (SELECT unnest(range(300)) AS k) UNION ALL SELECT n + k, -(k % 70) FROM m, (SELECT unnest(range(500)) AS k)),
b AS (SELECT unnest(range(0, n // 128 + 6)) AS seq FROM m), e AS (SELECT seq, unnest(range(200))::INT AS pos FROM b)
SELECT seq, pos, coalesce(s.sample, 0)::INT AS sample FROM e LEFT JOIN s ON s.frame = seq * 128 - 400 + pos""")
def q82_gather(spark, sf_dir):
    """Samples of planned blocks, with a region before the stream, one after it, and zeros beyond."""
    own = _as_stream(spark, sf_dir).where("channel = 0").select("stream", "frame", "sample")
    k = F.col("id").alias("k")
    zero = F.lit(0).cast("bigint").alias("stream")
    prime = spark.range(300).select(zero, k, F.pmod("id", F.lit(50)).cast("int").alias("sample"))
    tail = spark.range(500).select(zero, k, (-F.pmod("id", F.lit(70))).cast("int").alias("sample"))
    blocks = own.groupBy("stream").agg((F.max("frame") + 1).alias("n"))
    plan = blocks.select("stream", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / 128) + 5)).alias("seq"))
    plan = plan.select("stream", "seq", (F.col("seq") * 128 - 400).alias("sample_start"), (F.col("seq") * 128 - 200).alias("sample_end"))
    got = framing.gather(plan, framing.regions(prime, tail, own))
    return got.select("seq", F.posexplode("s").alias("pos", "sample"))


@query("""SELECT p_partkey, p_size, greatest(0, least(p_size, p_size - (p_partkey % 9 - 2)))::BIGINT AS carry, pow(2, p_size % 12)::BIGINT AS block,
list_extract([256, 128, 86, 64], (p_partkey % 4 + 1)::INT) AS levels, ((least(p_size * 3, 100) - 7) - (least(p_size * 3, 100) - 7) % 4) // 4 AS parts,
concat('g', p_partkey % 2 + 1, '-', p_size % 6 + 1, 'ch-', 48000, '-', p_brand) AS description FROM part""")
def q83_small_rules(spark, sf_dir):
    """Band carry, block sizes, heights of a multiplier, partition counts and descriptions."""
    size, key = F.col("p_size"), F.col("p_partkey")
    text = quality.profile_description((F.pmod(key, F.lit(2)) + 1).cast("int"), (F.pmod(size, F.lit(6)) + 1).cast("int"), F.lit(48000), F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", N.band_carry(size, F.pmod(key, F.lit(9))).cast("bigint").alias("carry"), N.block_size(F.pmod(size, F.lit(12))).alias("block"),
        N.multiplier_range((F.pmod(key, F.lit(4)) + 1).cast("int")).alias("levels"), floors.partition_count(F.lit(7), size * 3, F.lit(100), F.lit(4)).alias("parts"),
        text.alias("description"),
    )


BANDS = ([0.5, 1.0, 0.5], 2), ([0.25, 0.5, 1.0, 0.5], 9)


@query("""WITH e AS (SELECT vec_id AS idx, embedding AS v FROM embeddings)
SELECT idx, ((((v[3] * 0.5::FLOAT)::FLOAT + v[4])::FLOAT + (v[5] * 0.5::FLOAT)::FLOAT)::FLOAT)::DOUBLE AS low,
(((((v[10] * 0.25::FLOAT)::FLOAT + (v[11] * 0.5::FLOAT)::FLOAT)::FLOAT + v[12])::FLOAT + (v[13] * 0.5::FLOAT)::FLOAT)::FLOAT)::DOUBLE AS high FROM e""")
def q84_band_sums(spark, sf_dir):
    """Weighted sums of bands, each step in single precision."""
    sums = posts.band_sums(F.col("x"), [w for w, _ in BANDS], [at for _, at in BANDS])
    rows = A.spectrum_rows(spark, sf_dir).withColumn("s", sums)
    return rows.select("idx", F.element_at("s", 1).alias("low"), F.element_at("s", 2).alias("high"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 2654435761 + l_linenumber * 40503) % 4294967296 AS word FROM lineitem)
SELECT l_orderkey, l_linenumber, word, count(*) AS n, max((CASE WHEN word >= 2147483648 THEN -1 ELSE 1 END) * (word % 2097152)::DOUBLE * pow(2.0::DOUBLE, (word // 2097152) % 1024 - 788)) AS value
FROM w GROUP BY ALL""")
def q85_packed_float(spark, sf_dir):
    """Packed floats: sign, exponent and mantissa of 32-bit words."""
    word = F.pmod(F.col("l_orderkey") * 2654435761 + F.col("l_linenumber") * 40503, F.lit(4294967296))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", word.alias("word"))
    return rows.groupBy("l_orderkey", "l_linenumber", "word").agg(F.count("*").alias("n"), F.max(N.packed_float(F.col("word"))).alias("value"))


@query(f"""WITH {MONO}, words AS (SELECT idx, part // 4 AS word, sum(cls * pow(8, 3 - part % 4))::BIGINT AS w FROM classed GROUP BY idx, part // 4)
SELECT idx, part // 4 AS word, part % 4 AS place, cls::INT AS cls FROM classed""")
def q86_class_digits(spark, sf_dir):
    """Classes packed into words and taken apart again."""
    words = floors.class_word(_classes(spark, sf_dir), ("idx",), 8, 4)
    each = words.select("idx", "word", F.posexplode(floors.class_digits(F.col("cls_word"), 8, 4)).alias("place", "cls"))
    return each.select("idx", "word", F.col("place").cast("bigint").alias("place"), "cls")


@query("""WITH e AS (SELECT vec_id AS idx, embedding AS v FROM embeddings), s AS (SELECT idx, (generate_subscripts(v, 1) - 1)::INT AS bin, unnest(v)::DOUBLE AS c FROM e)
SELECT idx, bin, round(CASE WHEN bin >= 50 THEN c WHEN bin % 7 = 0 THEN 0 ELSE c / (0.25::DOUBLE + bin) END, 9) + 0.0::DOUBLE AS r FROM s""")
def q87_residue_row(spark, sf_dir):
    """Coefficients over a floor of 50 bins, none in every seventh; the tail stays."""
    floor = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.when(F.pmod(k, F.lit(7)) == 0, 0.0).otherwise(k + 0.25))
    rows = A.spectrum_rows(spark, sf_dir).withColumn("r", floors.residue_row(F.col("x"), floor))
    return rows.select("idx", F.posexplode("r").alias("bin", "r")).select("idx", "bin", (F.round("r", 9) + 0.0).alias("r"))


@query(f"""WITH rows AS (SELECT vec_id AS idx, embedding AS v FROM embeddings), s AS (SELECT idx, (generate_subscripts(v, 1) - 1)::INT AS bin, unnest(v)::DOUBLE AS c FROM rows),
k AS (SELECT unnest(range(64))::INT AS place)
SELECT idx, place, round(sum(c * CASE WHEN place = 0 THEN 1 WHEN place = 63 THEN CASE WHEN bin % 2 = 0 THEN 1 ELSE -1 END WHEN place % 2 = 1 THEN cos(2 * pi() * bin * ((place + 1) // 2) / 64) ELSE -sin(2 * pi() * bin * (place // 2) / 64) END), 6) + 0.0::DOUBLE AS y
FROM s, k GROUP BY idx, place""")
def q88_packed_spectrum(spark, sf_dir):
    """The Fourier transform of real samples in packed order."""
    rows = _rows64(spark, sf_dir).select("idx", F.posexplode(spectral.packed_spectrum(F.col("x"), 64)).alias("place", "y"))
    return rows.select("idx", "place", (F.round("y", 6) + 0.0).alias("y"))


@query(f"""WITH {PACKETS}, near AS (SELECT stream, seq, mode, CASE WHEN mode = 1 THEN 2048 ELSE 256 END AS bs, coalesce(lead(mode) OVER w, 1) AS following, coalesce(lag(mode) OVER w, 0) AS previous
  FROM packets WINDOW w AS (PARTITION BY stream ORDER BY seq)),
c AS (SELECT *, coalesce(sum((bs + CASE WHEN following = 1 THEN 2048 ELSE 256 END) // 4) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS centre FROM near),
slots AS (SELECT DISTINCT stream, (size * 7 + seq * 13) % 40 AS q FROM packets)
SELECT stream, seq, (CASE WHEN mode = 1 THEN 2 + (previous = 1 AND following = 1)::INT
ELSE (NOT EXISTS (SELECT 1 FROM slots s WHERE s.stream = c.stream AND s.q >= trunc((centre - 128) / 64.0::DOUBLE) AND s.q < trunc((centre + 128) / 64.0::DOUBLE)))::INT END)::INT AS code FROM c""")
def q89_transition_codes(spark, sf_dir):
    """Codes of planned blocks from their neighbours and from transients near short ones."""
    rows = A.packets(spark, sf_dir)
    slots = rows.select("stream", F.pmod(F.col("size") * 7 + F.col("seq") * 13, F.lit(40)).alias("q"), F.lit(1).alias("slot"))
    coded = schedule.transition_codes(schedule.plan(rows.select("stream", "seq", "mode")), slots)
    return coded.select("stream", "seq", "code")


@query(f"""WITH RECURSIVE {PCM}, x AS (SELECT user_id AS stream, event_id AS i, (sample / 32768.0::DOUBLE)::FLOAT AS x,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM pcm),
run(stream, i, k, x, y) AS (SELECT stream, i, k, x, x FROM x WHERE k = 1
  UNION ALL SELECT n.stream, n.i, n.k, n.x, ((n.x - r.x)::FLOAT + (0.9921875::FLOAT * r.y)::FLOAT)::FLOAT FROM run r JOIN x n ON n.stream = r.stream AND n.k = r.k + 1)
SELECT stream, i, greatest(-32768, least(32767, round_even(y::DOUBLE * 32767, 0)))::INT AS sample FROM run""")
def q90_dc_quantized(spark, sf_dir):
    """The high-pass with its output as 16-bit samples again."""
    out = spectral.dc_filter(A.user_signal(spark, sf_dir), quantized=True)
    return out.select("stream", "i", (F.col("y") * 32768).cast("int").alias("sample"))
