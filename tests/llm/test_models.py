"""Classifiers by held-out accuracy and awkward rows; vectors against brute force; the pipeline."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from meshloom.llm import embedding_dedup, quality, queries, toxicity
from meshloom.plans import scratch

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{TABLES}/labels.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, 5.0), (2, "", 5.0), (3, "\n \t", 5.0), (4, "word " * 30_000, 5.0), (5, "a", None), (5, "a", None), (None, "b c", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double")


@pytest.fixture(scope="module")
def model(docs, labels):
    return toxicity.fit(docs, labels)


def _counts(scores, labels, column, threshold):
    m = scores.join(labels, "doc_id").where(~toxicity.in_training(F.col("doc_id"))).select("score", column).toPandas()
    hit = m["score"] >= threshold
    return (hit == (m[column] == 1)).mean(), len(m)


def test_toxicity_held_out(docs, labels, model):
    right, n = _counts(toxicity.score(docs, model), labels, "toxic", 0.5)
    assert n > 50 and right > 0.94


def test_quality_held_out(docs, labels):
    right, n = _counts(quality.score(docs, labels), labels, "quality", 0.3)
    assert n > 50 and right > 0.95


@pytest.mark.parametrize("noisy", ["1d10t", "m0r0n", "l.o.s.e.r", "idiooot", "tr4sh", "w0rthle$$", "sc*m", "cl0wn!!", "!diot", "MORON,"])
def test_deobfuscation(model, noisy):
    assert model.token(noisy.lower()) > 0


WHOLE = ["i" + 25 * "-" + "d10t", "i.....d.....i.....o.....t", "id" + 60 * "d" + "iot", "1" + 300 * "-" + "d" + 200 * "." + "iot", "---i---d---1---0---t---", "iiiiddddiiiiooootttt"]


@pytest.mark.parametrize("noisy", WHOLE)
def test_whole_tokens_are_decoded(model, noisy):
    """Nothing of a token is cut off before it is decoded, however long its runs are."""
    one = toxicity.Model({"idiot": 3.0}, model.language, (0.0, 1.0, 1.0))
    assert one.token(noisy) == 3.0 and model.token(noisy) > 0
    assert one.restore("so " + noisy) == "so idiot"


def test_long_tokens_end_soon(model):
    import time

    began = time.process_time()
    for token in ("1d" + "ab1c" * 250_000, "!" * 500_000 + "x", "i" + "漢" * 200_000, "i-" * 300_000):
        model.token(token)
    assert time.process_time() - began < 60


def test_spellings_without_letters(model):
    """Signs alone can spell a word; numbers, prices and dates never do."""
    one = toxicity.Model({"sit": 3.0, "ass": 3.0}, model.language, (0.0, 1.0, 1.0))
    assert one.token("$!+") == 3.0
    assert [one.token(t) for t in ("455", "$1135", "4-5-5", "1135.", "12:30", "+1", "50%", "(984)", "555-4072")] == [0.0] * 9


def test_words_of_fixed_phrases_are_learned(spark):
    """A word that always follows the same word is learned from what comes after it; its copies in one text count once."""
    rng = np.random.default_rng(9)
    rows, marks = [], []
    for i in range(900):
        words = [f"w{x}" for x in rng.integers(0, 300, 12)]
        words = ["".join(chr(97 + int(c)) for c in w[1:]) * 2 for w in words]
        if i % 3 == 0:
            words[5:5] = ["utter", "blorgfest"]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    m = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    assert m.weight("blorgfest") > 0 and m.token("bl0rgfest") > 0


def test_queries_of_classifiers(spark):
    """Columns, ranges and held-out rows of op6 and op7; a row for each document."""
    import zlib

    small = "/root/testdata/sf0.001"
    ids = [r["doc_id"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()]
    for query, threshold in ((queries.op6_quality, 0.3), (queries.op7_toxicity, 0.5)):
        rows = query(spark, small).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    missing = spark.createDataFrame([(None,)], "doc_id long").select(toxicity.in_training(F.col("doc_id"))).first()[0]
    assert missing is False


def test_repeated_training_rows(spark, labels):
    """Rows that repeat ids give the model of the rows once each."""
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(60)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    again = quality.score(once.union(once).union(once), marks).dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    assert [r["score"] for r in again] == [r["score"] for r in quality.score(once, marks).orderBy("doc_id").collect()]


def test_spaced_words_and_clean_words(model):
    assert model.hits("you are an i d i o t and a s c u m")[0] >= 1
    assert model.hits("the 3rd b2b call is at 10:30, see https://example.org/a1b2c3 or a a a a a a")[0] == 0


def test_scores_of_awkward_rows(spark, awkward, docs, labels, model):
    for scored in (toxicity.score(awkward, model), quality.score(awkward, labels)):
        rows = scored.collect()
        assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    kept = toxicity.drop_toxic(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == 7
    none = awkward.limit(0)
    assert toxicity.score(none, model).count() == 0 and quality.score(none, labels).count() == 0


def test_no_labels(spark, docs, labels):
    none = labels.limit(0)
    m = toxicity.fit(docs.limit(20), none)
    assert toxicity.score(docs.limit(5), m).where("score > 0.01").count() == 0
    assert quality.score(docs.limit(5), none).where("score < 0.99").count() == 0


def test_quality_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit(x, y)
    assert ((m.score(x) > 0.5) == (y > 0)).mean() > 0.9 and (0, 1) in m.pair_tables


# -- vectors ----------------------------------------------------------------


def brute_links(ids, vectors, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    link = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], dtype=float), np.array(vectors[j], dtype=float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    label = list(ids)
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
    return {i: (int(link[k].sum()), label[k], label[k] == i) for k, i in enumerate(ids)}


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    vectors = [
        None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, base.tolist(), base.tolist(), (3 * base).tolist(),
        (-base).tolist(), [1.0, 2.0], [1.0, 2.0], [1.0, 2.1], *(base + 0.05 * rng.standard_normal((20, 16))).tolist(), *rng.standard_normal((20, 16)).tolist(),
    ]
    vectors = [v if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    rows = [(i, v, 0, 1) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_links(list(range(len(vectors))), vectors)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold are found nearly always; nothing below it links."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.standard_normal(x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    above = 0.952 * x + np.sqrt(1 - 0.952**2) * e
    below = 0.945 * x - np.sqrt(1 - 0.945**2) * e
    rows = [(int(i + k * 1000), v.tolist()) for k, block in enumerate((x, above, below)) for i, v in enumerate(block)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert sum(got[i] for i in range(400)) >= 0.9 * 400 and sum(got[2000 + i] for i in range(400)) == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    rows = df.collect()
    want = brute_links([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values()) and got.keys() == want.keys()


def random_vectors(spark, n):
    """Of every 100 vectors, one has a near copy."""
    x = np.random.default_rng(5).standard_normal((n, 64)).astype(np.float32)
    x[1::100] = x[::100] + 0.01 * x[2::100]
    return spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)})), x.nbytes


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_vectors_write_little(spark):
    """Scratch tables and shuffles together stay under 4 times the vectors' bytes."""
    df, nbytes = random_vectors(spark, 20_000)
    before, at = shuffled(spark), scratch.mark()
    got = embedding_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    tables = [Path(path.removeprefix("file://")) for _, path in scratch._written[at:]]
    written = sum(f.stat().st_size for t in tables for f in t.rglob("*.parquet"))
    assert got == 400
    assert 0 < shuffled(spark) - before + written < 4 * nbytes


def test_no_vector_is_sampled(spark, monkeypatch):
    """Counts come from the threshold and the length; vectors of few components, in a narrow cone, link as others do."""

    limit = DataFrame.limit

    def one_row(df, n):
        assert n <= 1, "rows were sampled"
        return limit(df, n)

    rng = np.random.default_rng(6)
    x = np.zeros((3000, 64))
    x[:, :6] = 1 + rng.standard_normal((3000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(3000), "embedding": list(x.astype(np.float32))}))
    monkeypatch.setattr(DataFrame, "limit", one_row)
    found = embedding_dedup.near_duplicates(frame).agg(F.sum("n_links")).collect()[0][0]
    assert 0.9 * ((c >= 0.95).sum() - 3000) <= found <= ((c >= 0.9499999).sum() - 3000)


def test_vectors_grow_in_step(spark):
    """Five times the vectors shuffle less than 5 ** 1.3 times the bytes, and a vector's comparisons do not follow their number."""
    took = []
    for n in (8_000, 40_000):
        df, before = random_vectors(spark, n)[0], shuffled(spark)
        embedding_dedup.near_duplicates(df).write.format("noop").mode("overwrite").save()
        took.append(shuffled(spark) - before)
    assert took[1] < 5**1.3 * took[0]
    layouts = {n: embedding_dedup.layout(64, n, 0.95) for n in (1 << 14, 1 << 24)}
    compared = [e.probes**2 * n / e.cells for n, e in layouts.items()]
    assert compared[1] < 10 * compared[0]


# -- registration and pipeline ----------------------------------------------


def test_queries_are_registered():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


def test_pipeline(spark):
    """The last table is what brute-force versions of the stages leave, given the model's rejections."""
    from collections import Counter

    import corpus_pipeline
    from meshloom.llm import mixing
    from tests.llm.test_text_operators import brute_copies, brute_join, reference_ids

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = {r["doc_id"]: r for r in docs.collect() if m.score(r["text"] or "") < 0.5}
    rows = [(i, r["text"]) for i, r in clean.items()]
    rows = [(i, clean[i]["text"]) for i, keep, *_ in brute_copies(rows) if i == keep]
    rows = [(i, clean[i]["text"]) for i, _, c in brute_join(rows) if i == c]
    left = spark.createDataFrame([(i, t, clean[i]["lang"], clean[i]["source"], clean[i]["n_chars"]) for i, t in rows], docs.schema)
    want = Counter()
    for r in mixing.mix(left).collect():
        want[r["doc_id"]] += len(r["shards"])
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in got) == +want
    assert all(r["n_tokens"] == len(reference_ids(clean[r["doc_id"]]["text"] or "")) // 4 for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]


def test_stages_send_small_batches(spark):
    """After any stage, whole texts go to Python workers in batches of few bytes; a lower bound of the session stays."""
    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    rows = pa.table({"doc_id": np.arange(3000), "text": ["word %d " % i + "x" * 4000 for i in range(3000)], "source": ["a"] * 3000})
    for own in (None, 1 << 18):
        session = spark.newSession()
        if own:
            session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", own)
        docs = session.createDataFrame(rows).coalesce(1)
        assert corpus_pipeline.encode(session, docs, "").count() == 3000
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 3000 and max(r["bytes"] for r in got) < 2 * (own or corpus_pipeline.BATCH_BYTES)
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
