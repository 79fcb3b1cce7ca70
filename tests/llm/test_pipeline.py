"""The pipeline against a brute-force version of its decisions on a small corpus."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_bagminhash import brute
from test_packing import verify
from test_toxicity import BAD, GOOD
from tokenizers import Tokenizer
import public_tokenizers as P

import corpus_pipeline as C

SECRET = "token=" + "a1B2c3D4e5F6g7H8"


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(240):
        words = [rng.choice(GOOD) + str(rng.randrange(60)) + " " + rng.choice(GOOD) for _ in range(rng.randint(6, 50))]
        toxic = i % 6 == 0
        if toxic:
            words.insert(3, rng.choice(BAD))
        if i % 10 == 3:
            words.append(SECRET + str(i))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    texts += [texts[1], texts[2] + " end", None, "", "x"]
    path = str(tmp_path_factory.mktemp("tables"))
    make_docs(texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_stages(spark, folder):
    path, texts = folder
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, path).cache()
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(set(range(len(texts))) - kept["toxicity"].keys() - toxic) == 0  # no clean document goes
    assert len(toxic & kept["toxicity"].keys()) <= 2
    rows = [(i, texts[i]) for i in kept["toxicity"]]
    assert kept["near_dedup"].keys() == {c for _, c, _ in brute(rows)}
    assert kept["secrets"].keys() == kept["near_dedup"].keys()
    for i, text in kept["secrets"].items():
        if i < 240 and i % 10 == 3:
            assert SECRET not in text and text.endswith("token=[SECRET]")
        else:
            assert text == texts[i]
    assert kept["mixing"].keys() <= kept["secrets"].keys() and len(kept["mixing"]) > 0.4 * len(kept["secrets"])
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = [tuple(r)[:7] for r in C.packing_stage(spark, docs, path).collect()]
    verify(pieces, {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in kept["mixing"].items()})


def test_run_equals_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, path)
    want = sorted((r.doc_id, r.start, r.length) for r in C.packing_stage(spark, docs, path).collect())
    got = sorted((r.doc_id, r.start, r.length) for r in C.run(spark, path).collect())
    assert {x[0] for x in got} == {x[0] for x in want} and sum(x[2] for x in got) == sum(x[2] for x in want)
    assert C.ORACLE_SQL is None


def test_odd_rows_and_clashing_columns(spark, folder, odd_docs):
    from pyspark.sql import functions as F

    path, _ = folder
    clash = {c: F.lit(1) for c in ("score", "predicted", "key", "root", "spans", "node", "topic", "p", "w", "tokens", "tier", "bucket", "shard")}
    docs = odd_docs.withColumns(clash)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), path).count() == 0
    assert C.packing_stage(spark, docs, path).count() >= docs.count()


READ, SENT = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_whole_texts_are_read_in_small_batches(spark, folder, name):
    """A stage, called by itself, reads and hands on few whole texts at once, and still all of them."""
    path, texts = folder
    were = {k: spark.conf.get(k) for k in (READ, SENT)}
    try:
        for k in were:
            spark.conf.set(k, 10_000)
        docs = spark.read.parquet(f"{path}/documents.parquet")
        dict(C.STAGES)[name](spark, docs.limit(0), path)
        assert int(spark.conf.get(READ)) <= 256
        many = docs.crossJoin(spark.range(10)).coalesce(1)
        sizes = [r.n for r in many.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
        assert sum(sizes) == 10 * len(texts) and max(sizes) <= 512
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)


def test_smaller_batches_stay(spark):
    were = {k: spark.conf.get(k) for k in (READ, SENT)}
    try:
        for given, left in ((64, {READ: 64, SENT: 64}), (100_000, C.BATCHES)):
            for k in were:
                spark.conf.set(k, given)
            C.small_batches(spark)
            assert {k: int(spark.conf.get(k)) for k in were} == left
        spark.conf.set(SENT, 0)  # no bound
        C.small_batches(spark)
        assert int(spark.conf.get(SENT)) == C.BATCHES[SENT]
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
