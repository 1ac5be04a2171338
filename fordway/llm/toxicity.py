"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models of order `ORDER` are counted from labelled texts, one from toxic and one from ordinary ones. Each gives a
character after its context within the word as discounted counts of its own class plus a backoff weight times a
lower-order distribution that both share: Kneser-Ney continuation counts over all labelled texts, backed off order by
order down to the single character and then to all characters alike. So what is rare in one class and unseen in the
other is smoothed alike and cancels out, and forms of one stem share what is known of it. A word's evidence is the
difference of its two log-likelihoods. A text's is normalised by length twice: per character over the whole text, and
per character over each of its `TOP` most telling words, so that a few words count in a long text. A logistic curve
through labelled texts that were kept out of the counts turns both into a score from 0 to 1.

Counts are taken from the labelled texts of the folds for learning (crc32 of the id as text, mod 3, is not 1), whole,
without only those that the curve is fitted on: a sixth of these rows (crc32 mod 9 is 0), or a sample of it by a hash
of the id where that is over `most_calibration` rows; the rest of the sixth is counted. The n-gram table is exact and
distributed, keyed by the six characters themselves. Each n-gram's and context's evidence is kept; none is left out.

Up to `MOST_KEYS` of them, 12 bytes each, go to the workers, which look them up by a 64-bit hash. Beyond that, words
and n-grams meet by shuffle: texts' words are counted, the vocabulary's n-grams joined to their evidence, words to
their sums, and texts to their words, with hot words, n-grams and copied texts set apart. Evidence is held in whole
steps of 2^-20, so sums do not hang on their order and both ways give the same score. Labels are joined by broadcast up
to `BROADCAST_LABELS` rows and by shuffle beyond.

Null and empty texts have no evidence: they get the score of zeros. A null id has no label and is not held out. A
label row with a null is not used; of several label rows of one id the largest label counts. Repeated rows are scored
alike, and count as often as they are there. Without labelled rows all evidence is zero and the curve is the default
one. Only id, text and the labels are read; extra columns can have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Workspace, by_bytes, give_back, map_texts, table, texts
from .groups import join_one

ORDER = 6  # two numbers of three characters
TOP = 3
MOST_KEYS = 8_000_000
BROADCAST_LABELS = 1_000_000
DISCOUNT = 0.75
ALPHABET = 256
SUM_AT = 250_000  # n-grams that a task holds before it sums them up
CHUNK = 1 << 14  # words looked at together
MEMO = 100_000  # words that a task remembers
STEPS = 1 << 20  # of evidence in a unit
BITS = 21  # of a character
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1  # masks of the last one and two characters
GAP = " " * (ORDER - 1)


def spaced(words: list[str]) -> Iterator[str]:
    """The words, each after ORDER - 1 spaces, so that no context reaches over a word's start."""
    for k in range(0, len(words), CHUNK):
        yield GAP + GAP.join(words[k : k + CHUNK]) + " "


def packed(part: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low half of each n-gram that ends in a character of a word or the space after it, and which of these
    begin a word."""
    points = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1
    three = (points[:-2] << 2 * BITS) | (points[1:-1] << BITS) | points[2:]
    blank = points == 33
    last, before = blank[ORDER - 1 :], blank[ORDER - 2 : -1]
    used = ~(last & before)
    return three[:-3][used], three[3:][used], before[used]


def hashed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    h = high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h = (h + low.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """high, low (the n-gram), toxic, ordinary (counts) from rows (text, toxic)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: list[np.ndarray] = []  # rows of high, low, toxic count, ordinary count
        summed: list[np.ndarray] = []
        n_raw = n_summed = 0

        def merged(parts: list[np.ndarray]) -> np.ndarray:
            rows = np.concatenate(parts)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            first = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
            out = rows[first]
            out[:, 2:] = np.add.reduceat(rows[:, 2:], first, axis=0)
            return out

        def given(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(rows), 1 << 16):
                part = rows[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[:, c])) for c in range(4)], names=["high", "low", "toxic", "ordinary"])

        for batch in by_bytes(batches, "text"):
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for part in spaced(text.lower().split()):
                    high, low, _ = packed(part)
                    n = len(high)
                    raw.append(np.stack([high, low, np.full(n, int(toxic > 0)), np.full(n, int(toxic <= 0))], axis=1))
                    n_raw += n
                    if n_raw > SUM_AT:
                        summed.append(merged(raw))
                        n_summed += len(summed[-1])
                        raw, n_raw = [], 0
                        if n_summed > 3 * SUM_AT:
                            rows = merged(summed)
                            summed, n_summed = [rows], len(rows)
                            if n_summed > 2 * SUM_AT:
                                yield from given(rows)
                                summed, n_summed = [], 0
        if raw or summed:
            yield from given(merged(summed + raw))
        raw, summed = [], []
        give_back()

    part = labelled.select("text", "toxic").mapInArrow(run, "high long, low long, toxic long, ordinary long")
    return part.groupBy("high", "low").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _bits(c: str, mask: int) -> Column:
    return F.col(c).bitwiseAND(F.lit(mask)) if mask else F.lit(0).cast("long")


#: For orders 5 to 1: which characters of the next higher order's two halves a suffix keeps.
SUFFIXES = {5: (TWO, -1), 4: (ONE, -1), 3: (0, -1), 2: (0, TWO), 1: (0, ONE)}


def continuations(ws: Workspace, grams: DataFrame) -> DataFrame:
    """high, low (the suffix of order 5), shared: Kneser-Ney's distribution of what follows a context, whatever stands
    before, interpolated down to all characters alike. A context is its suffix without the last character."""
    d = F.lit(DISCOUNT)
    above, kinds = grams.select("high", "low"), {}
    for order, masks in SUFFIXES.items():
        above = kinds[order] = ws.store(above.groupBy(*[_bits(c, m).alias(c) for c, m in zip(("high", "low"), masks, strict=True)]).agg(F.count("*").alias("before")), f"order-{order}")
    shared = None
    for order in sorted(kinds):
        rows = kinds[order].withColumn("context", F.shiftright("low", BITS))
        whole = rows.groupBy("high", "context").agg(F.sum("before").alias("all"), F.count("*").alias("kinds"))
        rows = rows.join(whole, ["high", "context"])
        if shared is None:
            lower = F.lit(1 / ALPHABET)
        else:
            below = SUFFIXES[order - 1]
            rows = rows.withColumns({"h": _bits("high", below[0]), "l": _bits("low", below[1])}).join(shared.select(F.col("high").alias("h"), F.col("low").alias("l"), "shared"), ["h", "l"])
            lower = F.col("shared")
        shared = rows.select("high", "low", ((F.col("before") - d + d * F.col("kinds") * lower) / F.col("all")).alias("shared"))
    return shared


def evidence(ws: Workspace, grams: DataFrame) -> DataFrame:
    """high, low, value: log-likelihood differences of n-grams seen, and of contexts (of five characters: the low half
    holds two) followed by anything else."""
    grams = ws.store(grams.withColumn("context", F.shiftright("low", BITS)), "grams")
    d = F.lit(DISCOUNT)
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    contexts = grams.groupBy("high", "context").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o"), seen("toxic").alias("t_kinds"), seen("ordinary").alias("o_kinds"))
    contexts = ws.store(contexts, "contexts")
    shared = continuations(ws, grams).select(F.col("high").alias("h"), F.col("low").alias("l"), "shared")
    whole = grams.withColumns({"h": _bits("high", TWO), "l": F.col("low")}).join(contexts, ["high", "context"]).join(shared, ["h", "l"])

    def probability(n: str, total: str, kinds: str):
        own = (F.greatest(F.col(n) - d, F.lit(0.0)) + d * F.col(kinds) * F.col("shared")) / F.greatest(F.col(total), F.lit(1))
        return F.when(F.col(total) > 0, own).otherwise(F.col("shared"))

    steps = lambda v: F.round(v * STEPS).cast("int").alias("value")
    of_grams = whole.select("high", "low", steps(F.log(probability("toxic", "t", "t_kinds")) - F.log(probability("ordinary", "o", "o_kinds"))))
    weight = lambda total, kinds: F.when(F.col(total) > 0, d * F.col(kinds) / F.greatest(F.col(total), F.lit(1))).otherwise(F.lit(1.0))
    of_contexts = contexts.select("high", F.col("context").alias("low"), steps(F.log(weight("t", "t_kinds")) - F.log(weight("o", "o_kinds"))))
    return of_grams.unionByName(of_contexts)


class Lookup:
    """The evidence by sorted hashes, and what is asked of it for whole batches."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        # where the keys of each leading bits begin: more places than keys, so few of them share one
        counts = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.starts = np.zeros((1 << bits) + 1, np.int32 if len(keys) < 1 << 31 else np.int64)
        np.cumsum(counts, out=self.starts[1:])
        self.memo: dict[str, int] = {}

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some keys, 0 where there is none, and which are there."""
        values, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = (keys >> self.shift).astype(np.int64)
        at, end = self.starts[place], self.starts[place + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == keys[left]
            values[left[hit]], known[left[hit]] = self.values[at[hit]], True
            more = ~hit & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return values, known

    def words(self, words: list[str]) -> Iterator[int]:
        """The evidence of each word, in steps."""
        for part in spaced(words):
            high, low, begins = packed(part)
            each, known = self.look(hashed(high, low))
            each[~known] = self.look(hashed(high[~known], low[~known] >> BITS))[0]
            yield from np.add.reduceat(each, np.flatnonzero(begins)).tolist()

    def features(self, batch: list[str]) -> tuple[list[float], list[float]]:
        """Mean difference by character of each text, and of its most toxic words."""
        split = [x.lower().split() for x in batch]
        new = list(set().union(*split).difference(self.memo))
        self.memo.update(zip(new, self.words(new), strict=True))
        means, peaks = [], []
        for own in split:
            if not own:
                means.append(0.0)
                peaks.append(0.0)
                continue
            value = np.array([self.memo[w] for w in own], np.int64)
            size = np.array([len(w) for w in own], np.int64) + 1
            means.append(int(value.sum()) / STEPS / int(size.sum()))
            rate = value / size
            top = np.sort(rate if len(rate) <= TOP else np.partition(rate, -TOP)[-TOP:])
            peaks.append(float(np.cumsum(top)[-1]) / len(top) / STEPS)  # one by one, as the join adds them
        if len(self.memo) > MEMO:
            self.memo.clear()
        return means, peaks


def looked_up(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all keys, in order, and their values, on the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = (batch.column(c).to_numpy() for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(hashed(high, low).view(np.int64)), batch.column(2)], names=["key", "value"])

    rows = found.select("high", "low", "value").mapInArrow(run, "key long, value int").toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["value"].to_numpy()[order]


@dataclass
class Model:
    """The evidence, a stored table; its hashes and values where they are few enough to be broadcast; the curve."""

    evidence: DataFrame
    table: tuple[np.ndarray, np.ndarray] | None
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


def features(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns, mean and peak, for every row."""
    if model.table is None:
        return _features_by_join(docs, model.evidence, keep, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model.table)

    def make():
        own = Lookup(*shared.value)
        return lambda batch: dict(zip(("mean", "peak"), own.features(batch), strict=True))

    return map_texts(docs, keep, text_col, "mean double, peak double", make, most=1 << 20)


def _features_by_join(docs: DataFrame, found: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    ws = Workspace(docs.sparkSession, "toxic-words")
    inner = [f"k{i}" for i in range(len(keep))]
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(*[docs[c].alias(n) for n, c in zip(inner, keep, strict=True)], text.alias("text")).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64("text", F.lit(1))})

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            for a, b, x in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                of = Counter(x.lower().split())
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(of), pa.int64()), pa.array([b] * len(of), pa.int64()), pa.array(list(of), pa.string()), pa.array(list(of.values()), pa.int64())], names=["a", "b", "word", "times"])
        give_back()

    def grams_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "word", 1 << 20):
            first = 0
            for part in spaced(batch.column("word").to_pylist()):
                high, low, begins = packed(part)
                owner = first + np.cumsum(begins) - 1
                first = int(owner[-1]) + 1
                yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(owner)), pa.array(high), pa.array(low)], names=["word", "high", "low"])
        give_back()

    kinds = keyed.groupBy("a", "b").agg(F.min("text").alias("text"), F.count("*").alias("n"))
    kinds = ws.store(kinds, "texts")
    rows = ws.store(kinds.select("a", "b", "text").mapInArrow(counted, "a long, b long, word string, times long"), "words")
    vocabulary = ws.store(rows.groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
    parts = ws.store(vocabulary.select("word").mapInArrow(grams_of, "word string, high long, low long"), "grams")
    asked = parts.groupBy("high", "low").agg(F.count("*").alias("n"))
    known = asked.join(found.select("high", "low", "value"), ["high", "low"], "left").withColumn("context", F.shiftright("low", BITS))
    rest = found.where(F.col("low") <= TWO).select("high", F.col("low").alias("context"), F.col("value").alias("rest"))
    valued = known.join(rest, ["high", "context"], "left").select("high", "low", "n", F.coalesce("value", "rest", F.lit(0)).cast("long").alias("value"))
    sums = join_one(parts, ws.store(valued, "valued"), ["high", "low"], parts.count()).groupBy("word").agg(F.sum("value").alias("value"))
    sums = ws.store(sums.join(vocabulary, "word"), "sums")
    size = (F.char_length("word") + 1).cast("long")
    both = join_one(rows, sums, "word", rows.count()).withColumns({"size": size, "rate": F.col("value") / size})
    top = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("rate", F.least("times", F.lit(TOP)).cast("int")))), asc=False), 1, TOP)
    of = both.groupBy("a", "b").agg(F.sum(F.col("value") * F.col("times")).alias("value"), F.sum(F.col("size") * F.col("times")).alias("size"), top.alias("top"))
    # sums run from the least to the most telling, as they do where one task has the whole text
    total = F.aggregate(F.reverse("top"), F.lit(0.0), lambda x, y: x + y)
    of = kinds.select("a", "b", "n").join(of, ["a", "b"], "left")
    of = of.select("a", "b", "n", F.coalesce(F.col("value") / STEPS / F.col("size"), F.lit(0.0)).alias("mean"), F.coalesce(total / F.size("top") / STEPS, F.lit(0.0)).alias("peak"))
    of = ws.store(of, "features")
    ws.keep("features")
    return join_one(keyed, of, ["a", "b"], of.agg(F.sum("n")).first()[0] or 0).select(*inner, "mean", "peak").toDF(*keep, "mean", "peak")


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression with a slight pull to a default curve, by Newton's method."""
    default = np.array([4.0, 4.0, -4.0])
    design, w = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, 3)), default.copy()
    pull = np.diag([0.02, 0.02, 0.02])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + pull, design.T @ (y - p) - pull @ (w - default))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fold(id_col: str, folds: int = 3):
    """crc32 of the id as text, mod folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fold(id_col: str, folds: int = 3):
    """crc32 of the id as text, mod folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_calibration: int = 20_000, most_keys: int = MOST_KEYS) -> Model:
    """The model from labelled rows of the folds for learning."""
    ws = Workspace(docs.sparkSession, "toxicity")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where((fold("id") != 1) & F.col("toxic").isNotNull()).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = ws.store(known, "labels")
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(fold("id") != 1)
    n = known.count()
    # labels of one id are few, texts of one id too; neither side of this join has a hot key
    labelled = mine.join(F.broadcast(known) if n <= BROADCAST_LABELS else known, "id")
    share = min(1.0, most_calibration / max(1, n / 6))
    # a bounded sample by a hash of the id, for a curve of three parameters
    apart = (fold("id", 9) == 0) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = ws.store(evidence(ws, gram_counts(labelled.where(~apart))), "evidence")
    model = Model(found, looked_up(found) if found.count() <= most_keys else None)
    rows = features(labelled.where(apart), model, ["toxic"]).toArrow()
    x = np.column_stack([rows["mean"].to_numpy(), rows["peak"].to_numpy()])
    y = rows["toxic"].to_numpy().astype(float)
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    model.curve = fit_curve(x[order], y[order])
    ws.keep("evidence")
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and score, for every row."""
    inner = [f"x{i}" for i in range(len(keep))]
    found = features(docs, model, keep, text_col).toDF(*inner, "mean", "peak")
    a, b, c = model.curve
    z = F.least(F.greatest(F.col("mean") * a + F.col("peak") * b + c, F.lit(-60.0)), F.lit(60.0))
    return found.select(*inner, (1 / (1 + F.exp(-z))).alias("score")).toDF(*keep, "score")


THRESHOLD = 0.7


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; a null text stays as it is."""
    model = fit(docs, labels, id_col, text_col)
    inner = docs.toDF(*[f"x{i}" for i in range(len(docs.columns))])
    scored = score(inner, model, inner.columns, inner.columns[docs.columns.index(text_col)])
    return scored.where(F.col("score") < threshold).drop("score").toDF(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
