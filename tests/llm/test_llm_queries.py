"""Registered corpus queries against their SQL, and the pipeline against its stages done by hand."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from harness import compare
from pyspark.sql import functions as F
from test_operators import brute_near, brute_repeats, documents, naive_quality, naive_toxicity, texts

import corpus_pipeline
from wavemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == ""


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables like the driver's, with the fixture's texts."""
    path = tmp_path_factory.mktemp("sf")
    df = documents(spark, texts(11, 150), repeat=False).withColumn("lang", F.lit("en"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in ids] + [(None, 1, 1), (9999, 0, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {r.doc_id: r.text for r in df.collect()}


def sha(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def test_op4_query(spark, small):
    path, text = small
    want = brute_repeats(list(text.items()))
    got = queries.queries()["op4_suffixes"](spark, path).collect()
    assert len(got) == len(text)
    for r in got:
        n_bytes, n_removed, n_spans, left = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n_bytes, n_removed, n_spans, sha(left))


@pytest.mark.parametrize("name, n, out, least", [("op7_toxicity", 5, 0, 0.5), ("op9_quality", 4, 2, 0.7)])
def test_classifier_queries(spark, small, name, n, out, least):
    path, text = small
    got = queries.queries()[name](spark, path).collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text)
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    if name == "op7_toxicity":
        weights = queries.toxicity.fit(docs, labels, lambda key: queries.id_remainder(key, 5) != 0)
        score = lambda t: naive_toxicity(weights, t)
    else:
        net = queries.quality_network(spark, docs, path)
        score = lambda t: naive_quality(net, (t or "").encode())
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == out) and r.predicted == int(r.score >= least)
        if len(text[r.doc_id] or "") < 3000:
            assert r.score == pytest.approx(score(text[r.doc_id]), abs=1e-3)


def test_op8_query(spark, small):
    from tokenizers import Tokenizer

    path, text = small
    library = Tokenizer.from_file(queries.vocabulary())
    got = queries.queries()["op8_bpe"](spark, path).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), sha(",".join(map(str, ids)).encode()), sha(decoded.encode()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_op10_query(spark, small):
    path, text = small
    got = queries.queries()["op10_sharding"](spark, path).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    places = defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        places[r.shard].append(r.slot)
    assert set(places) <= set(range(40)) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = queries.quality_network(spark, docs, SF)
    scored = corpus_pipeline.bytecnn.score(docs, net).where("score >= 0.7").collect()
    best = {}
    for r in scored:
        best[r.text or ""] = max(r.doc_id, best.get(r.text or "", -1))
    near = brute_near([(i, t) for t, i in best.items()])
    keep = sorted(i for i, (_, c) in near.items() if c == i)
    left = docs.where(docs.doc_id.isin(keep))
    stream = corpus_pipeline.mixing.mix(left, position="at").collect()
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in stream)
    # The corpus carries the order of training.
    got.sort(key=lambda r: r.position)
    assert len({r.position for r in got}) == len(got)
    at = {}
    for r in stream:
        at.setdefault(r.doc_id, []).append(r["at"])
    places = [at[r.doc_id].pop(0) for r in got]
    assert places == sorted(places) and not any(at.values())
    from tokenizers import Tokenizer

    library, text = Tokenizer.from_file(queries.vocabulary()), {r.doc_id: r.text for r in left.collect()}
    assert all(r.token_ids == library.encode(text[r.doc_id], add_special_tokens=False).ids for r in got[:50])


def test_pipeline_of_nothing_and_of_nulls(spark, small, tmp_path):
    path, text = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").where("quality = 1")  # all that is known is good
    some = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("doc_id")
    for name, rows in (("none", docs.limit(0)), ("nulls", docs.select(some, *docs.columns[1:]))):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/nulls").cache()
    assert got.where("position is null").count() == 0 < got.where("doc_id is null").count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
