"""Toxicity by noisy-channel deobfuscation and a learned lexicon.

Learning, from a bounded sample of labelled rows: words and word beginnings
whose documents are toxic far more often than chance become lexicon entries
with log-odds weights.  Support counts distinct neighbours on the side that has
more of them, so that a group of near copies counts about once and a word of a
fixed phrase as often as the phrase.  A character language model, counted over
all documents, is mixed with one of the lexicon's spellings.

Restoring: tokens that are not plain words, stretched words and runs of single
characters become lattices; a lattice offers, for each character, the letters
it may stand for, and lets separators and repeats vanish at a cost.  Viterbi
decoding under the language model restores a spelling, of whole tokens: runs of
separators and of equal characters are squeezed first, and a path keeps as many
letters as tell whether it is an entry.  Among the spellings of nearly the best
probability the one of most weight stands in the restored text.  The score of a
document is a logistic function of the lexicon hits in its restored text.

Defined cases: null and empty texts have no hits and get the score of such
texts.  Without labels of both kinds every score is the share of toxic labels,
0 where there are none.  Labels that are null are left out; a label whose
document is missing has no effect.  Repeated rows are scored each for itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.llm.bpe import KEPT_BYTES, OVERHEAD
from meshloom.llm.workers import tidy
from meshloom.plans.scratch import materialize

#: Labelled rows that the model is fitted on, at most: those with the smallest hashed ids.
MAX_LABELLED = 30_000
PREFIXES = (4, 5, 6)
MIN_NEIGHBOURS = 4
#: Support times log-odds of an entry at least.
MIN_EVIDENCE = 18.0

# Letters of the language model, and the letters that characters may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßğışčž"
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "¥": "y",
    "а": "a", "в": "b", "е": "e", "і": "i", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SEPARATORS = set(".,-_*~ '`^:;/\\=+#%&­​‌‍⁠﻿")

SIZE = 64
_idle = SEPARATORS - set(STANDS_FOR)
_code = {c: i + 1 for i, c in enumerate(LETTERS)}
_table = np.zeros(0x250, dtype=np.int64)
for _c, _i in _code.items():
    _table[ord(_c)] = _i
_words = re.compile(r"[^\W\d_]+").findall
_stretched = re.compile(r"(.)\1\1").search
_runs = re.compile(r"(.)\1{2,}")
_number = re.compile(r"[#$€£+(<|!.-]*\d[\d.,:;/\-'`^~=_\s]*[%)€£$+*!|.,;:?\"']*").fullmatch
_LEADING, _TRAILING, _CLOSING = frozenset("!$@(|+"), frozenset("$@!+|"), ".,;:?\"')"
_edges = ".,;:!?\"'()[]{}<>*%$&#|-_=+/\\~`^"

#: Spellings count whose log probability is less than this below the best.
MARGIN = 5.0
REPLACED, DROPPED, REPEATED = -1.5, -1.0, -0.5  # costs of the channel, as log probabilities


def features(word: str) -> Iterator[str]:
    """The entries that a word can match: itself, and its beginnings with a ``^``."""
    if len(word) >= 3:
        yield word
    for n in PREFIXES:
        if len(word) > n:
            yield "^" + word[:n]


#: Characters that are counted at once.
COUNTED = 1 << 18


def letter_counts(texts: Iterable[str]) -> np.ndarray:
    """Counts of letter trigrams; 0 stands for any other character, and nothing is remembered beyond one."""
    total = np.zeros(SIZE**3, dtype=np.int64)
    held, size = [], 0
    for text in texts:
        for at in range(0, len(text), COUNTED):
            # Pieces of a long text overlap by two characters, which the cut between texts would hide.
            held.append(text[max(0, at - 2) : at + COUNTED])
            size += len(held[-1])
            if size > COUNTED:
                total += _counted(held)
                held, size = [], 0
    return total + _counted(held) if held else total


def _counted(texts: list[str]) -> np.ndarray:
    points = np.frombuffer("  ".join([*texts, ""]).lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(points < len(_table), _table[np.minimum(points, len(_table) - 1)], 0)
    if len(codes) < 3:
        return np.zeros(SIZE**3, dtype=np.int64)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    a = np.where(b == 0, 0, a)
    return np.bincount((a * SIZE + b) * SIZE + c, minlength=SIZE**3)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """``log p(c | a, b)``, interpolated with shorter memories."""
    t = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    bi, uni = t.sum(0), t.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SIZE)
    p2 = (bi + 4 * p1) / (bi.sum(1, keepdims=True) + 4)
    p3 = (t + 4 * p2[None]) / (t.sum(2, keepdims=True) + 4)
    return np.log(p3)


def squeezed(noisy: str) -> str:
    """A token with runs of separators that stand for no letter as one, and of equal characters as three."""
    out: list[str] = []
    for ch in noisy:
        if ch in _idle and out and out[-1] in _idle or len(out) > 2 and out[-1] == out[-2] == out[-3] == ch:
            continue
        out.append(ch)
    return "".join(out)


@dataclass
class Model:
    """``entries``: weights of the lexicon; ``language``: log probabilities; ``logistic``: bias and slopes."""

    entries: dict[str, float] = field(default_factory=dict)
    language: np.ndarray | None = None
    logistic: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        spelled = [e.lstrip("^") for e in self.entries]
        self.starts = {e[:2] for e in spelled}
        self.longest = max(map(len, spelled), default=0)
        self.enough = max(self.longest, *PREFIXES) + 1  # letters that tell whether a word matches an entry
        self.kept: dict[str, float] = {}
        self.held = 0

    def weight(self, word: str) -> float:
        """The largest weight of the entries that a plain word matches."""
        return max((self.entries.get(f, 0.0) for f in features(word)), default=0.0)

    def decode(self, noisy: str) -> list[str]:
        """Restored spellings of a noisy token, the best of each end state that comes near the best, best first.

        Spellings of more than ``enough`` letters are cut there, and decoding ends once all are.
        """
        lp, enough = self.language, self.enough
        noisy = squeezed(noisy)
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        before = ""
        for at, ch in enumerate(noisy):
            if at % 32 == 31 and all(len(made) >= enough for _, made in states.values()):
                break
            options = [(ch, 0.0)] if ch in _code else []
            options += [(x, REPLACED) for x in STANDS_FOR.get(ch, "")]
            drop = DROPPED if ch in SEPARATORS else REPEATED if ch == before else None
            if not options and drop is None:
                drop = 3 * DROPPED
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, made) in states.items():
                if drop is not None and (x := score + drop) > after.get((a, b), (-math.inf,))[0]:
                    after[a, b] = (x, made)
                for letter, cost in options:
                    c = _code[letter]
                    x = score + cost + float(lp[a, b, c])
                    if x > after.get((b, c), (-math.inf,))[0]:
                        after[b, c] = (x, made + letter if len(made) < enough else made)
            states, before = after, ch
        ends = sorted(((s + float(lp[a, b, 0]), made) for (a, b), (s, made) in states.items()), reverse=True)
        return [made for s, made in ends if s > ends[0][0] - MARGIN]

    def _can_start(self, noisy: str) -> bool:
        """Whether the lattice's first letters, those of four runs of equal characters, can begin an entry."""
        heads, before, runs = {""}, "", 0
        for ch in noisy:
            if ch in _idle:
                continue
            runs += ch != before
            if runs > 4:
                break
            before = ch
            heads |= {h + x for h in heads if len(h) < 2 for x in ((ch if ch in _code else "") + STANDS_FOR.get(ch, ""))}
        return not self.starts.isdisjoint(heads)

    def _best(self, spelled: list[str]) -> tuple[float, str]:
        """The spelling of most weight, the first among equals."""
        return max(((self.weight(s), s) for s in spelled), key=lambda x: x[0], default=(0.0, ""))

    def restored(self, noisy: str) -> tuple[float, str]:
        """The weight and the spelling of a noisy token once it is decoded; no weight where that is no entry."""
        if self.language is None or not self.entries or not self._can_start(noisy):
            return 0.0, noisy
        letters = [c for c in _runs.sub(r"\1\1\1", noisy) if c in _code or c in STANDS_FOR]
        return self._best(self.decode(noisy)) if len(letters) >= 3 else (0.0, noisy)

    def restored_run(self, run: str) -> tuple[float, str]:
        """The weight and the spelling of single characters in a row, in which words may follow each other."""
        run = _runs.sub(r"\1\1", run)
        if self.language is None or not self.entries or len(run) < 4:
            return 0.0, run
        best = (0.0, run)
        # Words within a long run begin anywhere; windows overlap by the longest entry twice stretched.
        width = max(64, 4 * self.longest)
        for at in range(0, max(1, len(run) - width // 2), width // 2):
            for spelled in self._decode_all(run[at : at + width]):
                inside = max((w for e, w in self.entries.items() if len(e) >= 4 and e[0] != "^" and e in spelled), default=0.0)
                best = max(best, (max(inside, self.weight(spelled) if at == 0 else 0.0), spelled), key=lambda x: x[0])
        return best

    def _decode_all(self, run: str) -> list[str]:
        """As ``decode``, with all letters of a short run."""
        enough, self.enough = self.enough, len(run)
        try:
            return self.decode(run)
        finally:
            self.enough = enough

    def spelling(self, token: str) -> tuple[float, str]:
        """The weight of a token between white space, and how the restored text spells it."""
        words = _words(token)
        if not words and (_number(token) or sum(c in STANDS_FOR for c in token) < 3):
            return 0.0, token
        if words and (best := max(map(self.weight, words))):
            return best, token
        core = token.strip(_edges)
        forms = {core} if not words or core != words[0] or _stretched(core) else set()
        if token[0] in _LEADING:
            forms.add(token.rstrip(_edges))
        if token.rstrip(_CLOSING)[-1:] in _TRAILING:
            forms.add(token.lstrip(_edges).rstrip(_CLOSING))
        if not words:
            forms.add(token.strip(_CLOSING))
        best = max(map(self.restored, sorted(forms)), key=lambda x: x[0], default=(0.0, token))
        return best if best[0] else (0.0, token)

    def token(self, token: str) -> float:
        """The weight of a token between white space."""
        return self.spelling(token)[0]

    def restore(self, text: str) -> str:
        """The text in lower case with noisy tokens, and runs of single characters, as decoded where that makes entries."""
        tokens = text.lower().split()
        out = [self.spelling(t)[1] for t in tokens]
        single = [i for i, size in enumerate(map(len, tokens)) if size == 1]
        for run in _spaced(single) if len(single) >= 4 else ():
            weight, spelled = self.restored_run("".join(tokens[i] for i in run))
            if weight:
                out[run[0]] = spelled
                for i in run[1:]:
                    out[i] = ""
        return " ".join(t for t in out if t)

    def hits(self, text: str) -> tuple[int, float]:
        """How many tokens match, and the sum of the distinct ones' weights."""
        tokens = text.lower().split()
        if self.held > KEPT_BYTES:
            self.kept, self.held = {}, 0
        kept, found = self.kept, set(tokens)
        for new in found.difference(kept):
            kept[new] = self.token(new)
            self.held += OVERHEAD + len(new)
        some = {t for t in found if kept[t]}
        n = sum(t in some for t in tokens) if some else 0
        total = sum(kept[t] for t in some)
        single = [i for i, size in enumerate(map(len, tokens)) if size == 1]
        if len(single) >= 4:
            for run in _spaced(single):
                if w := self.restored_run("".join(tokens[i] for i in run))[0]:
                    n, total = n + 1, total + w
        return n, total

    def score(self, text: str) -> float:
        n, total = self.hits(text)
        return logistic(self.logistic, math.log1p(n), math.log1p(total))


def _spaced(at: list[int]) -> Iterator[list[int]]:
    """Runs of four or more consecutive positions."""
    run = [at[0]]
    for i in [*at[1:], -2]:
        if i == run[-1] + 1:
            run.append(i)
            continue
        if len(run) >= 4:
            yield run
        run = [i]


def logistic(w: tuple[float, float, float], n: float, total: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * n + w[2] * total))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """A ridge-penalised logistic regression, by Newton steps."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in w)


def in_training(doc_id: Column) -> Column:
    """Rows that labels may be learned from; the others are held out, and rows without an id are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``limit`` labelled training rows, one for each id (its least text), written once."""
    rows = labels.where(in_training(F.col("doc_id")) & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    chosen = rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # limit rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialize(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "labelled")


def _bucket(word: str) -> int:
    return 1 << (int.from_bytes(word.encode()[-8:], "little") * 0x9E3779B97F4A7C15 >> 20 & 63)


def _toxic_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a feature, and hashed sets of the words before and after it."""
    docs: Counter[str] = Counter()
    masks: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for batch in batches:
        for text in batch.column("text"):
            words = [w for t in (text.as_py() or "").lower().split() for w in _words(t)]
            seen = set()
            for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                bits = _bucket(before), _bucket(after)
                for f in features(word):
                    seen.add(f)
                    for mask, bit in zip(masks, bits, strict=True):
                        mask[f] = mask.get(f, 0) | bit
            docs.update(seen)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(f, n, signed(masks[0][f]), signed(masks[1][f])) for f, n in docs.items()]
    for at in range(0, len(rows), 50_000):
        f, n, before, after = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(f), *(pa.array(x, pa.int64()) for x in (n, before, after))], ["feature", "n", "before", "after"])


def _class_counts(train: DataFrame) -> DataFrame:
    """``(feature, toxic, clean)``: documents of each class with a feature."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                words = {w for t in set((text.as_py() or "").lower().split()) for w in _words(t)}
                counts[y > 0].update({f for w in words for f in features(w)})
        both = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(both), 50_000):
            part = both[at : at + 50_000]
            columns = [pa.array(part, pa.string())] + [pa.array([counts[k][f] for f in part], pa.int64()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])

    counted = train.select("text", "y").mapInArrow(tidy(work), "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def corpus_letters(docs: DataFrame) -> np.ndarray:
    """Letter trigram counts over all documents; a task sends ``SIZE ** 3`` numbers at most."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            total += letter_counts(x.as_py() or "" for x in batch.column("text"))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    counts = np.zeros(SIZE**3, dtype=np.int64)
    for r in docs.select("text").mapInArrow(tidy(work), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["code"]] = r["n"]
    return counts


def _lexicon(train: DataFrame) -> dict[str, float]:
    """Log-odds of the features with enough evidence; all features are weighed, in Spark, and only those that pass are collected."""
    found = train.where("y > 0").select("text").mapInArrow(tidy(_toxic_features), "feature string, n long, before long, after long")
    spread = F.greatest(F.bit_count(F.bit_or("before")), F.bit_count(F.bit_or("after")))
    spreads = found.groupBy("feature").agg(spread.alias("spread")).where(F.col("spread") >= MIN_NEIGHBOURS)
    by_class = {r["y"]: r["n"] for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    support = F.least(F.col("toxic").cast("double"), -64 * F.log(1 - F.least(F.col("spread").cast("double"), F.lit(63.5)) / 64))
    log_share = lambda n, y: F.log((n + 0.5) / F.lit(by_class.get(y, 0) + 1))
    weighed = _class_counts(train).join(spreads, "feature").withColumn("support", support)
    weighed = weighed.withColumn("odds", log_share(F.col("support"), 1) - log_share(F.col("clean"), 0))
    passing = weighed.where((F.col("odds") > math.log(10)) & (F.col("support") * F.col("odds") >= MIN_EVIDENCE))
    return {r["feature"]: r["odds"] for r in passing.select("feature", "odds").orderBy("feature").collect()}


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Learn from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``."""
    train = labelled(docs, labels, "toxic", limit)
    classes = {r["y"]: r["n"] for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        share = 1.0 if classes.get(1) else 0.0
        return Model(logistic=(60 * share - 30, 0.0, 0.0))
    entries = _lexicon(train)
    spelled = np.zeros(SIZE**3, dtype=np.int64)
    for entry in entries:
        spelled += letter_counts([entry.lstrip("^")])
    corpus = log_probabilities(corpus_letters(docs))
    model = Model(entries, np.logaddexp(corpus, log_probabilities(spelled)) - math.log(2))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.hits(t.as_py() or "") for t in batch.column("text")]
            columns = [pa.array([math.log1p(v[k]) for v in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("y")], ["n", "total", "y"])

    model.kept = {}
    rows = train.select("text", "y").mapInArrow(tidy(work), "n double, total double, y int").toPandas()  # limit rows of three numbers
    weights = fit_logistic(rows[["n", "total"]].to_numpy(), (rows["y"] > 0).to_numpy(dtype=float))
    return Model(entries, model.language, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)``, a row for each row of ``docs``."""
    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py() or "") for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)


def restored_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, text)``: the restored text of each row of ``docs``, in lower case; null: empty."""
    schema = docs.select("doc_id", F.lit("").alias("text")).schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([model.restore(t.as_py() or "") for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(tidy(work), schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([model.score(t.as_py() or "") < threshold for t in batch.column("text")], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(tidy(work), docs.schema)
