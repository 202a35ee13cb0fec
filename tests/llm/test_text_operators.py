"""Operators on texts against brute force, over awkward rows and a small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshloom.llm import bpe, exact_dedup, mixing, ngram_join, records, sharding, substring_dedup
from meshloom.llm.queries import MULTILINGUAL_RANKS, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, shard int, kept string, size long, tile long"
SMALL = "/root/testdata/sf0.001"


def _row(i, text, source="a"):
    return (i, text, None, source, 9, "x", -1, 3)


LONG = " ".join(f"w{k % 997}x{k}" for k in range(3000))
PASSAGE = " ".join(f"p{k}" for k in range(60))
AWKWARD = [
    _row(1, None), _row(2, ""), _row(3, " \t\n\r\x0b\x0c "), _row(4, "one"), _row(5, "a b  c\nd"), _row(6, "abcd", None), _row(7, LONG, None),
    _row(8, LONG + " tail"), _row(9, PASSAGE), _row(10, "x y z " + PASSAGE + " end of it"), _row(11, "A B C D e"), _row(12, "a b c d E"),
    _row(13, "naïve café 漢字 🙂 <|endoftext|>  two  spaces "), _row(14, "ab ab ab " * 40), _row(5, "a b  c\nd"), _row(None, "nobody"), _row(None, None),
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


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# -- substring dedup --------------------------------------------------------


def brute_substrings(rows, window):
    split = [words(t) for _, t in rows]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 10])
def test_substring_dedup(spark, awkward, small, window):
    for df in (awkward, small):
        got = [tuple(r) for r in substring_dedup.remove_repeats(df, window, min(8, window - 2)).collect()]
        assert sorted(got, key=str) == brute_substrings(texts(df), window)


def test_substring_kept_texts(awkward):
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.kept_texts(awkward).collect()}
    assert kept[10] == "x y z end of it" and kept[9] == "" and kept[8] == "tail"


# -- n-gram join ------------------------------------------------------------


def brute_join(rows, n=5):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x] if j < i).items():
            if rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def test_ngram_join(awkward, small):
    for df in (awkward, small):
        got = [tuple(r) for r in ngram_join.components(df).collect()]
        assert sorted(got, key=str) == brute_join(texts(df))


def test_ngram_join_of_near_copies_and_chains(spark, monkeypatch):
    """Large groups of near copies, chains of links, and one passage in many texts; tiny chunks force tiles."""
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    rng = np.random.default_rng(0)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[int(rng.integers(len(w)))] = f"n{i}"
        rows.append((i, " ".join(w)))
    chain = [f"c{k}" for k in range(200)]
    for i in range(12):
        rows.append((100 + i, " ".join([*chain[9 * i :], *(f"e{k}" for k in range(9 * i))])))
    for i in range(40):
        rows.append((200 + i, PASSAGE + " " + " ".join(f"u{i}v{k}" for k in range(25))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.components(df).collect()), key=str)
    assert got == brute_join(rows)
    assert len({c for d, _, c in got if 100 <= d < 200}) < 12


def test_bitmaps_bound_differences():
    rng = np.random.default_rng(1)
    for size in (3, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 1 << 63, size * 2 // 3, dtype=np.uint64)]))
        x, y = ngram_join.bitmap(a), ngram_join.bitmap(b)
        n = min(len(x), len(y))
        differ = int(np.bitwise_count(ngram_join.folded(x, n) ^ ngram_join.folded(y, n)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_drop_near_copies_keeps_one_of_each(awkward):
    kept = ngram_join.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 8 not in ids and 7 in ids and 12 not in ids and 11 in ids and 1 in ids and 2 in ids


# -- exact dedup ------------------------------------------------------------


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(words(t))].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        plain = "".join(words(t))
        keep = min(groups[plain], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [exact_dedup.MAX_FILTER_BITS, 1 << 16])
def test_exact_dedup(awkward, small, bits):
    for df in (awkward, small):
        assert sorted((tuple(r) for r in exact_dedup.decide(df, bits).collect()), key=str) == brute_copies(texts(df))


def test_drop_copies(awkward):
    kept = exact_dedup.drop_copies(awkward)
    assert kept.columns == awkward.columns
    want = {i for i, keep, *_ in brute_copies(texts(awkward)) if i == keep}
    got = [r["doc_id"] for r in kept.collect()]
    assert set(got) == want and len(got) == len(want)


def test_drop_copies_keeps_the_longest_row_of_an_id(spark):
    """Rows of one id whose texts are equal but for white space; repeated rows; a column named like the operator's own."""
    rows = [(1, "ab", 0), (1, "a b", 1), (1, " a  b", 2), (2, "ab", 3), (None, "ab", 4), (None, None, 5), (None, "", 6), (3, "x", 7), (3, "x", 8), (None, "y", 9), (None, "y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own int").selectExpr("*", "own as _row", "1 as digest")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert [x for x in got if x not in ((None, None), (None, ""))] == sorted([(1, " a  b"), (3, "x"), (None, "y")], key=str) and len(got) == 4


# -- sharding ---------------------------------------------------------------


def test_sharding(awkward, small):
    for df in (awkward, small):
        rows, given = sharding.assign(df, 8).collect(), texts(df)
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given if i is not None
        )
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[k]) for k in range(8)]
        assert sum(counts) == len(given) and max(counts) - min(counts) <= 1


def test_sharding_of_a_hot_id(spark):
    """Rows of one id, a null one too, get slots of their own; the query states its law."""
    from meshloom.llm import queries

    df = spark.range(400).selectExpr("if(id % 3 = 0, 7L, if(id % 3 = 1, null, id)) as doc_id", "concat('t', id % 5) as text")
    rows = sharding.assign(df, 8).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == 400 and all(sorted(v) == list(range(50)) for v in by.values()) and len(by) == 8
    rows = queries.op2_sharding(spark, SMALL).collect()
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)} and len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_sharding_follows_the_ring(spark, small):
    """Places by brute force: a key belongs to its cell's arc until that shard is full, then to the next with room."""
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["shard"] for r in sharding.assign(small, 8).collect()}
    hashed = small.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 48).alias("cell"), F.xxhash64("doc_id").alias("place")).collect()
    ring = sharding.ring(8)
    room = [len(hashed) // 8 + (k < len(hashed) % 8) for k in range(8)]
    arc = lambda cell: next((k for k, (at, _) in enumerate(ring) if at >= cell), 0)
    want, late = {}, []
    for r in sorted(hashed, key=lambda r: (r["cell"], r["place"])):
        shard = ring[arc(r["cell"])][1]
        if room[shard]:
            room[shard] -= 1
            want[r["doc_id"]] = shard
        else:
            late.append(r)
    for r in late:
        step = next(s for s in range(1, len(ring) + 1) if room[ring[(arc(r["cell"]) + s) % len(ring)][1]])
        shard = ring[(arc(r["cell"]) + step) % len(ring)][1]
        room[shard] -= 1
        want[r["doc_id"]] = shard
    assert got == want


def test_written_shards_and_mix(spark, small, tmp_path):
    """Every row once in its shard, slots in order in each file; the mix's rows in local order; clashing columns are refused."""
    written = sharding.write_shards(small, f"file://{tmp_path}/shards", 8)
    assert sorted(r["doc_id"] for r in written.collect()) == sorted(r["doc_id"] for r in small.collect())
    mix = mixing.mix(small, 4).collect()
    copies = mixing.write_mix(small, f"file://{tmp_path}/mix", 4).collect()
    assert Counter((r["doc_id"], r["shard"]) for r in copies) == Counter((r["doc_id"], s) for r in mix for s in r["shards"])
    for write in (sharding.write_shards, mixing.write_mix):
        with pytest.raises(ValueError):
            write(small.selectExpr("*", "1 as shard"), f"file://{tmp_path}/none")


def test_ring_moves_little():
    counts = {c: 20 for c in range(0, 1 << 16, 64)}
    place = {}
    for n in (8, 9):
        pieces = sharding.plan(counts, n, sharding.ring(n))
        place[n] = {(c, k): s for c, ps in pieces.items() for a, b, s, _ in ps for k in range(a, b)}
    moved = sum(place[8][k] != place[9][k] for k in place[8]) / len(place[8])
    assert moved < 0.35  # a modulo would move 8 of 9


# -- mixing -----------------------------------------------------------------


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5]) and mixing.targets([], []) == []


def test_mixing(small):
    rows = mixing.mix(small).collect()
    assert len(rows) == small.count() and all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by)
    want = mixing.targets([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want, strict=True):
        assert all(r["target"] == pytest.approx(t) for r in by[s])
        left = [r["size"] for r in by[s] if r["size"] and r["taken"] < 3 * r["size"]]
        assert abs(sum(r["taken"] for r in by[s]) - t) <= max(left, default=0) + 1
    again = {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in mixing.mix(small).collect()}
    assert again == {(r["doc_id"], r["taken"], tuple(r["shards"])) for r in rows}


def test_mix_is_what_the_tree_deals(spark, monkeypatch):
    """Copies a shard and source of the query are the quotas that the splitting tree drew, in blocks of one document."""
    from meshloom.llm import queries

    monkeypatch.setattr(mixing, "MIN_BLOCK", 1)
    drawn = []
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, rng: drawn.append(tree(q, n, rng)) or drawn[-1])
    rows = queries.op5_mixing(spark, SMALL).collect()
    assert all(r["taken"] == r["size"] * len(r["shards"]) for r in rows)
    whole = max(drawn, key=lambda x: x.shape)  # of all shards
    assert whole.shape[0] == 16 and np.ptp(whole.sum(1)) <= 4
    got = Counter(s for r in rows for s in r["shards"])
    assert len(got) == 16 and max(got.values()) < 2 * min(got.values())
    assert len({r["place"] for r in rows}) == len(rows)


def test_mixed_rows_match_decisions(small, awkward):
    for df in (small, awkward):
        decided = Counter()
        for r in mixing.mix(df).collect():
            decided[r["doc_id"]] += len(r["shards"])
        got = mixing.mixed(df)
        assert got.columns == df.columns
        assert Counter(r["doc_id"] for r in got.collect()) == +decided


def test_splitting_tree():
    quotas = np.array([40, 0, 7, 100])
    split = mixing.splitting_tree(quotas, 5, np.random.default_rng(3))
    assert (split.sum(0) == quotas).all() and np.ptp(split.sum(1)) <= 3 and (split >= 0).all()


# -- tokens -----------------------------------------------------------------


def reference_ids(text):
    import base64

    import public_tokenizers
    import tiktoken

    if not hasattr(reference_ids, "own"):
        with open(MULTILINGUAL_RANKS, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        reference_ids.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return np.array(reference_ids.own.encode_ordinary(text), dtype="<u4").tobytes()


def test_byte_bpe(awkward, small):
    for df in (awkward, small):
        got = sorted((tuple(r) for r in bpe.round_trip(df, MULTILINGUAL_RANKS).collect()), key=str)
        want = []
        for i, t in texts(df):
            ids = reference_ids(t or "")
            want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
    data = bpe.decode(bpe.encode(awkward, MULTILINGUAL_RANKS), MULTILINGUAL_RANKS).collect()
    assert sorted(bytes(r["data"]) for r in data) == sorted((t or "").encode() for _, t in texts(awkward))


def library_ids(text, special_as_text=False):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "own"):
        library_ids.own = Tokenizer.from_file(TOKENIZER)
        library_ids.plain = Tokenizer.from_file(TOKENIZER)
        library_ids.plain.encode_special_tokens = True
    return (library_ids.plain if special_as_text else library_ids.own).encode(text, add_special_tokens=False).ids


def test_records(spark, awkward, small, tmp_path):
    for k, df in enumerate((awkward, small)):
        path = f"file://{tmp_path}/{k}"
        records.write(df, path, TOKENIZER)
        index = records.starts(records.write_index(spark, path)).orderBy("file", "offset").collect()
        want = sorted(((i, t) for i, t in texts(df)), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [r["doc_id"] for r in index] == [i for i, _ in want]
        start = 0
        for r in index:
            assert r["start"] == start
            start += r["n_tokens"]
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in records.read(spark, path).collect()) == Counter((i, (*library_ids(t or ""), 0)) for i, t in want)


def test_records_of_added_tokens(spark, tmp_path):
    """An added token's content becomes that token, as the library has it, or stays text if that is asked for."""
    found = ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|> a", "a<|endoftext", "<|endoftext|>  b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "doc_id long, text string")
    for special_as_text in (False, True):
        path = f"file://{tmp_path}/{special_as_text}"
        records.write(df, path, TOKENIZER, special_as_text=special_as_text)
        got = {r["doc_id"]: list(r["ids"]) for r in records.read(spark, path).collect()}
        assert got == {i: [*library_ids(t, special_as_text), 0] for i, t in enumerate(found)}
    assert library_ids(found[0]) == [87, 220, 50256, 331]


def test_records_in_chunks(spark, small, tmp_path, monkeypatch):
    """Files end at their bound; order, starts and checksums hold over files of a range, and repeated ids are dealt over ranges."""
    import zlib

    monkeypatch.setattr(records, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(records, "RANGE_BYTES", 60_000)
    same = small.select("doc_id", "text").union(small.selectExpr("7L as doc_id", "concat('again ', text) as text"))
    path = f"file://{tmp_path}/chunks"
    records.write(same, path, TOKENIZER)
    index = records.starts(records.write_index(spark, path)).orderBy("part", "chunk", "offset").collect()
    assert len({r["chunk"] for r in index}) > 3 and len({r["part"] for r in index if r["doc_id"] == 7}) > 1
    assert [r["doc_id"] for r in index] == sorted(r["doc_id"] for r in same.collect())
    start = 0
    for r in index:
        assert r["start"] == start
        start += r["n_tokens"]
    want = Counter((i, zlib.crc32(np.array([*library_ids(t or ""), 0], dtype="<u4").tobytes())) for i, t in texts(same))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in index) == want


def test_op8_query(spark):
    """Every column of the query against the library."""
    import zlib

    from meshloom.llm import queries

    got = {r["doc_id"]: r.asDict() for r in queries.op8_token_records(spark, SMALL).collect()}
    start = 0
    for i, t in sorted(texts(spark.read.parquet(f"{SMALL}/documents.parquet"))):
        ids = np.array([*library_ids(t or ""), 0], dtype="<u4")
        assert got[i] == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def test_piece_encoder_forgets():
    """Small generations change nothing but the time."""
    from meshloom.llm.pretokens import PieceEncoder

    made = PieceEncoder(lambda texts: [t.encode() for t in texts], most=100)
    rng = np.random.default_rng(6)
    for _ in range(400):
        text = " ".join(f"w{int(x)}{'.' * int(x % 3)}" for x in rng.integers(0, 300, 20))
        assert made.encode(text) == text.encode()
        assert len(made.kept) <= 100 + 40 and len(made.old) <= 140 and len(made.bare) <= 14 and len(made.tails) <= 14


def test_piece_encoder_agrees_with_the_library():
    own = records.encoder(TOKENIZER)
    rng = np.random.default_rng(5)
    marks = list(" \n\t.,'’sa1éB%  xy_\0")
    for _ in range(3000):
        text = "".join(rng.choice(marks, int(rng.integers(14))))
        assert np.frombuffer(own.encode(text), dtype="<u2").tolist() == library_ids(text), repr(text)


def test_damaged_records():
    data = records.frame(b"payload") + records.frame(b"")
    assert [p for _, p in records.frames(data)] == [b"payload", b""]
    for at in range(len(data)):
        with pytest.raises(ValueError):
            list(records.frames(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
    with pytest.raises(ValueError):
        list(records.frames(data[:-1]))


# -- empty tables -----------------------------------------------------------


@pytest.mark.parametrize(
    "run",
    [
        substring_dedup.remove_repeats, ngram_join.components, ngram_join.drop_near_copies, exact_dedup.decide, exact_dedup.drop_copies, sharding.assign,
        mixing.mix, mixing.mixed, lambda d: bpe.round_trip(d, MULTILINGUAL_RANKS),
    ],
)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_empty_records(spark, empty, tmp_path):
    path = f"file://{tmp_path}/none"
    records.write(empty, path, TOKENIZER)
    assert records.starts(records.write_index(spark, path)).count() == 0


# -- n-gram join: rows that meet oddly ----------------------------------------


def test_ngram_rows_of_one_id_and_clashing_names(spark):
    """Rows of one id are one document; repeated rows, null ids and columns with the operator's own names keep their place."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b + " end"), (7, c), (7, c), (None, c), (8, None), (6, c.upper())]
    df = spark.createDataFrame([(i, t, k, "x", "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _id int, _row string, component string")
    found = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.components(df).collect())
    assert found == Counter([(3, 3), (5, 3), (5, 3), (9, 3), (7, 6), (7, 6), (None, None), (8, 8), (6, 6)])
    kept = ngram_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, a), (None, c), (8, None), (6, c.upper())])


def test_ngram_long_document_and_hot_shingle(spark, monkeypatch):
    """A very long text links with its near copy; a shingle of many nodes is cut into chunks and loses no pair."""
    monkeypatch.setattr(ngram_join, "CHUNK", 8)
    rng = np.random.default_rng(3)
    long = [f"w{x}" for x in rng.integers(0, 1 << 40, 1_000_000)]
    rows = [(0, " ".join(long)), (1, " ".join(long[:900_000] + ["new"] * 5 + long[900_000:]))]
    base = [f"b{x}" for x in range(60)]
    for k in range(2, 62):
        own = list(base)
        for at in rng.choice(60, 1 + k % 3, replace=False):
            own[at] = f"c{k}x{at}"
        rows.append((k, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    assert got == {i: root(i) for i in sets}
