"""Collocations, the filter audit and packing against brute force, over awkward rows and a small table."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshloom.llm import collocations, filter_audit, packing, queries
from meshloom.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n long, phrase string, mask int, row long, part string"
SMALL = "/root/testdata/sf0.001"


def _row(i, text, lang="en", source="a"):
    return (i, text, lang, source, 1, "x", 2, 3, "y")


LONG = " ".join(f"w{k % 97} x{k % 11}" for k in range(4000))
AWKWARD = [
    _row(1, None), _row(2, ""), _row(3, " \t\n\r\x0b\x0c "), _row(4, "one"), _row(5, "a b  c\nd" * 30, None), _row(6, "A B, c d! " * 20, "und", None),
    _row(7, LONG), _row(8, LONG + " tail", "de"), _row(9, "New York is New York; new york, new\tyork " * 9), _row(10, LONG), _row(11, "in spite of it " * 14),
    _row(12, "naïve café 漢字 🙂 <|endoftext|>  two  spaces ", ""), _row(13, "ab ab ab " * 40), _row(5, "a b  c\nd" * 30, None), _row(None, "nobody"), _row(None, None),
    _row(10, LONG), _row(14, "AB#C", "en", ""), _row(0, "", "en", None), _row(15, "x " * 300, "en", "b"), _row(16, "\xff \x00 \x1c a", None, "b"), _row(17, "nobody"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- collocations -----------------------------------------------------------


def brute_phrases(docs, least, top, percent=50, longest=3):
    f = defaultdict(Counter)
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", low):
            words = re.findall("[^\\x20\\x09]+", piece)
            for m in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        n, found = sum(c for p, c in counts.items() if len(p) == 1), []
        many = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        within = defaultdict(int)
        for q, c in many.items():
            for part in {q[i : i + m] for m in range(2, len(q)) for i in range(len(q) - m + 1)}:
                within[part] = max(within[part], c)
        for p, a in many.items():
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * within[p] < percent * a:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "top", "longest", "shard"), [(10, 2000, 3, 1 << 22), (2, 7, 3, 50), (3, 40, 5, 300), (4, 9, 2, 1)])
def test_collocations(awkward, small, least, top, longest, shard):
    for df in (awkward, small):
        got = collocations.mine(df, longest, least, top, shard_words=shard)
        want = brute_phrases([tuple(r) for r in df.select("lang", "text").collect()], least, top, longest=longest)
        assert rows(got, "lang", "rank", "phrase", "a", "l", "r", "n", "score") == want


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 200).astype(np.int32)
    for depth in (1, 2, 3, 7, 200):
        order = collocations.suffix_array(ids, depth)
        heads = [tuple(ids[i : i + depth]) for i in order]
        assert sorted(order.tolist()) == list(range(200)) and heads == sorted(heads)
        shared = collocations.common_prefixes(ids, order, depth)
        for x, y, n in zip(heads, heads[1:], shared[1:], strict=False):
            assert n == next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    assert len(collocations.suffix_array(ids[:0], 3)) == 0


def test_products_beyond_64_bits(spark):
    a, left, right = 4 * 10**13 + 7, 7 * 10**13 + 1, 9 * 10**13 + 3
    table = spark.createDataFrame([("en", "x y", a), ("en", "x", left), ("en", "y", right)], collocations.COUNTS)
    assert collocations.scored(table).first()["score"] == 1_000_000 * a * a // (left * right)


# -- filter audit -----------------------------------------------------------


def brute_masks(docs):
    first, out = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, source in docs:
        t = text or ""
        w = re.findall("[^\\x20\\x09-\\x0D]+", t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t))
        fails += "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and i > first[t])
        out.append((i, source or "", fails))
    return out


def brute_audit(masked, labels):
    out = []
    for part in sorted({p for _, p, _ in masked}):
        own = [(fails, *labels.get(i, (0, 0))) for i, p, fails in masked if p == part]
        first = {order: Counter(next((x for x in order if x in fails), "") for fails, *_ in own) for order in permutations("ABCDE")}
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                gone = [(fails, q, t) for fails, q, t in own if x in fails and not set(order[: step - 1]) & set(fails)]
                failing = [fails for fails, *_ in own if x in fails]
                kept = sum(not set(order[:step]) & set(fails) for fails, *_ in own)
                out.append((part, "".join(order), step, kept, len(gone), len(failing) - len(gone), failing.count(x), sum(q for _, q, _ in gone), sum(t for *_, t in gone), sum(c[x] for c in first.values())))
    return sorted(out, key=str)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_masks_over_ranges(spark, awkward, partitions):
    """Equal texts over many ranges, with repeated ids at their borders."""
    copies = spark.range(300).select((F.col("id") % 150).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    df = awkward.select("doc_id", "text", "source").union(copies)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = filter_audit.masks(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    spelled = [(r["doc_id"], r["part"], "".join(x for k, x in enumerate("ABCDE") if r["mask"] >> k & 1)) for r in got]
    assert sorted(spelled, key=str) == sorted(brute_masks([tuple(r) for r in df.collect()]), key=str)


def test_filter_audit(spark, awkward, small):
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 1), (10, 1, 1), (None, 1, 1), (17, None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    known = {1: (1, 0), 2: (1, 1), 5: (1, 1), 10: (1, 1), 17: (0, 1)}
    read = spark.read.parquet(f"{SMALL}/labels.parquet")
    whole = {r["doc_id"]: (r["quality"], r["toxic"]) for r in read.collect()}
    for df, own, table in ((awkward, labels, known), (small, read, whole)):
        masked = brute_masks([tuple(r) for r in df.select("doc_id", "text", "source").collect()])
        assert rows(filter_audit.audit(df, own), *AUDIT) == brute_audit(masked, table)


def test_counters_add_up(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    masked = filter_audit.masks(small)
    whole = rows(filter_audit.counters(masked, labels), "part", "mask", "n", "good", "toxic")
    halves = filter_audit.counters(masked.where("doc_id % 2 = 0"), labels).union(filter_audit.counters(masked.where("doc_id % 2 = 1"), labels))
    assert rows(halves.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))), "part", "mask", "n", "good", "toxic") == whole


# -- packing ----------------------------------------------------------------


@pytest.mark.parametrize(("length", "most_open"), [(2048, 1024), (64, 8), (7, 1), (1, 1)])
def test_packing(awkward, small, length, most_open):
    library = Tokenizer.from_file(TOKENIZER)
    for df in (awkward, small) if length > 60 else (awkward,):
        pieces = packing.pack(df, TOKENIZER, length, most_open=most_open).collect()
        docs = Counter()
        for i, text in [tuple(r) for r in df.select("doc_id", "text").collect()]:
            docs[(i, np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())] += 1
        windows, runs = defaultdict(list), defaultdict(Counter)  # runs: of a document, by length
        for p in pieces:
            assert p["length"] >= 1 and len(p["ids"]) == 4 * p["length"]
            windows[p["sequence_id"]].append((p["offset"], p["length"]))
            runs[(p["doc_id"], p["doc_tokens"])][p["start"], bytes(p["ids"])] += 1
        padding = 0
        for window in windows.values():
            at = 0
            for offset, n in sorted(window):
                assert offset == at
                at += n
            assert at <= length
            padding += 0 if at.bit_count() == 1 else length - at
        assert padding == 0  # whole windows and powers of two alone
        for (i, data), n in docs.items():  # pieces start where others end; repeated documents may be cut in different places
            held = Counter()
            for (s, ids), c in runs[i, len(data) // 4].items():
                if data[4 * s : 4 * s + len(ids)] == ids:
                    held[s] += c
                    held[s + len(ids) // 4] -= c
            assert {s: c for s, c in held.items() if c} == {0: n, len(data) // 4: -n}


def test_packing_keeps_whole_documents(small):
    """Only documents longer than a window, and those of the windows closed at the end, are cut."""
    pieces = packing.pack(small.coalesce(1), TOKENIZER).collect()
    short = [p for p in pieces if p["doc_tokens"] <= 2048]
    whole = sum(p["length"] == p["doc_tokens"] for p in short)
    assert whole > 0.8 * len({p["doc_id"] for p in short})


def squares(levels, whole):
    return sum(n * n for level, n in Counter(x for x in levels if x < whole).items())


def test_best_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(7)
    for _ in range(300):
        whole = int(rng.integers(2, 30))
        levels = rng.integers(1, whole, int(rng.integers(0, 40))).tolist()
        counts = np.bincount(levels, minlength=whole + 1)
        size = int(rng.integers(1, whole))
        options = []
        for level in {0, *levels}:
            if level + size <= whole:
                after = [*levels, level + size]
                if level:
                    after.remove(level)
                options.append((squares(after, whole), -level))
        assert packing.best_level(counts, size) == -min(options)[1]


def test_many_windows_that_nothing_fits_are_poured():
    packer, done = packing.Packer(16, 10), []
    for i in range(500):
        done += packer.take(packing.Piece(i, 0, 9, np.full(9, i)))
        assert packer.n_open <= 11
    done += packer.end()
    assert sorted(Counter(sum(len(p.ids) for p in s) for s in done).items())[-1][0] == 16
    assert sum(len(p.ids) for s in done for p in s) == 4500 and not packer.n_open


def test_whole_sequences(awkward):
    pieces = packing.pack(awkward, TOKENIZER, 64)
    found = packing.sequences(pieces, 64, pad_id=5)
    for r in found.collect():
        ids = np.frombuffer(r["ids"], dtype="<u4")
        assert len(ids) == (r["n_tokens"] if r["n_tokens"].bit_count() == 1 else 64)
    assert found.agg(F.sum("n_tokens")).first()[0] == pieces.agg(F.sum("length")).first()[0]
    uneven = packing.sequences(pieces.where("sequence_id % 1099511627776 = 0 and offset = 0").limit(1).withColumn("ids", F.unhex(F.lit("0100000002000000ff010000"))).withColumn("length", F.lit(3)), 8, pad_id=258)
    assert np.frombuffer(uneven.first()["ids"], dtype="<u4").tolist() == [1, 2, 511, 258, 258, 258, 258, 258]


# -- queries ----------------------------------------------------------------


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name in ("op11_collocations", "op12_filter_audit"):
        got = queries.queries()[name](spark, SMALL)
        want = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names) and rows(got, *names) == sorted(want.fetchall(), key=str)


def test_sql_over_awkward_rows(spark, awkward, tmp_path):
    """The SQL states the same defined cases; ids are unique where SQL and operator have to agree on duplicates."""
    awkward.toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 1), (5, 0, 0), (10, 1, 0)], "doc_id long, quality int, toxic int").toPandas().to_parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("op11_collocations", "op12_filter_audit"):
        want = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in want.description]
        docs, labels = awkward, spark.read.parquet(f"{tmp_path}/labels.parquet")
        got = collocations.mine(docs) if "11" in name else filter_audit.audit(docs, labels)
        assert rows(got, *names) == sorted(want.fetchall(), key=str)


def test_packing_query(spark, small):
    got = queries.queries()["op13_packing"](spark, SMALL).collect()
    library = Tokenizer.from_file(TOKENIZER)
    ids = {r["doc_id"]: np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in small.collect()}
    for p in got:
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())
    assert sum(p["length"] for p in got) == sum(map(len, ids.values()))


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert collocations.mine(empty).count() == filter_audit.audit(empty, labels).count() == packing.pack(empty, TOKENIZER).count() == 0
    assert packing.sequences(packing.pack(empty, TOKENIZER)).count() == 0


def test_bad_parameters(empty):
    for bad in ({"longest": 1}, {"least": 0}, {"top": 0}):
        with pytest.raises(ValueError):
            collocations.mine(empty, **bad)
    with pytest.raises(ValueError):
        packing.pack(empty, TOKENIZER, 0)
