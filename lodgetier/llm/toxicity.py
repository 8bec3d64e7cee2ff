"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

For toxic and ordinary training documents each, a model gives the probability of a character after the
`ORDER` - 1 before it in its word. The highest order is counted per class, with absolute discounting; what
is discounted goes to the counts of both classes together, and from there to lower orders made of
continuation counts (in how many contexts a string occurs), so a rare expression has the same fallback in
either class. The log-likelihoods of a document's words are compared and divided by their number; words
whose likelihoods are within a margin of each other count as equal, so that the common words of a style
don't outweigh a few telling ones. A logistic curve fitted on training rows kept apart makes it a
probability.

A word counts once per document, since words come in bursts. Counts come from all training rows. Strings are
counted under 64-bit hashes in written tables that grow with the corpus, and each order is worked out by
grouped sums there. Documents are dealt to blocks of neighbouring ids; the distinct strings of a block are
joined to their log ratios, which then meet the block's documents. No task holds more of the model than the
strings of its block, and the driver holds none of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgetier.llm.base import crc_of_id, map_batches, payload, slices
from lodgetier.runtime import materialise

ORDER = 5
DISCOUNT = 0.75
CLASS_DISCOUNT = 4.0

#: Bytes of text whose documents meet their strings together.
BLOCK_BYTES = 32 << 20

#: Log ratio up to which a word counts as neutral, and the least mean excess that is told from none.
MARGIN = 2.0
FLOOR = 0.005
THRESHOLD = 0.7

#: Training rows used to fit the logistic curve: one in HELD, by hash, and of those at most MOST_FIT.
HELD = 6
MOST_FIT = 50_000

#: Words whose strings are worked out together.
WORDS = 20_000

#: Differences of words a task process keeps.
KEPT_WORDS = 200_000


def windows(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """(hashes, word, ends, letters): for each character, a hash of the `order` characters that end at it, the
    number of its word, and its place in the letters of all words.

    Words are lower-cased, led by order - 1 marks and closed by one.
    """
    lead = "\x01" * (order - 1)
    padded = [f"{lead}{w.lower()}\x02" for w in words]
    letters = "".join(padded)
    points = np.frombuffer(letters.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    ends = np.flatnonzero(np.arange(len(points)) - _starts(padded) >= order - 1)
    value = np.zeros(len(ends), dtype=np.uint64)
    for k in range(order):  # the string grows to the left
        value += (points[ends - k] + np.uint64(1)) * np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64))
    mixed = (value ^ (value >> np.uint64(32))) * np.uint64(0xD1342543DE82EF95)
    word = np.repeat(np.arange(len(padded)), [len(w) - order + 1 for w in padded])
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64), word, ends, letters


def _starts(padded: list[str]) -> np.ndarray:
    """For each character of some words end to end, where its word starts."""
    sizes = np.array([len(w) for w in padded], dtype=np.int64)
    return np.repeat(np.cumsum(sizes) - sizes, sizes)


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts toxic and ordinary of every string of `order` characters, its hash, its shorter strings s (those it
    ends with) and contexts c (those before its last character) by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = payload(batch.column("text")), batch.column("toxic").to_pylist()
            for i, j in slices(texts):
                counts = [Counter(), Counter()]
                for text, y in zip(texts[i:j], label[i:j]):
                    counts[int(y)].update(set(text.split()))
                met = sorted(counts[0].keys() | counts[1].keys())
                for k in range(0, len(met), WORDS):
                    words = met[k : k + WORDS]
                    hashes, word, ends, letters = windows([w.decode() for w in words], order)
                    per_word = np.array([[counts[1][w], counts[0][w]] for w in words], dtype=np.int64)
                    distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
                    grams = [letters[e - order + 1 : e + 1] for e in ends[sample].tolist()]
                    sums = [pa.array(np.bincount(which, weights=per_word[word, k]).astype(np.int64)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(distinct), *sums], ["string", "gram", "toxic", "ordinary"])

    found = map_batches(rows.select("text", "toxic"), run, "string string, gram long, toxic long, ordinary long")
    counts = found.groupBy("string").agg(F.min("gram").alias("gram"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    shorter = {f"s{k}": F.expr(f"right(string, {k})") for k in range(1, order)}
    contexts = {f"c{k}": F.expr(f"substring(string, {order - k}, {k})") for k in range(1, order)}
    return counts.withColumns(shorter | contexts).drop("string")


def _shared(counts: DataFrame, order: int, discount: float) -> DataFrame:
    """(s, shared): probability of the last character of each string of order - 1 after the others, in both
    classes, by continuation counts."""
    level, levels = counts, {}
    for k in range(order - 1, 0, -1):  # strings of k characters, by the kinds of strings they end
        less = [F.min(n).alias(n) for j in range(1, k) for n in (f"s{j}", f"c{j}")]
        level = materialise(level.groupBy(f"s{k}").agg(F.count("*").alias("kinds"), *less), f"strings{k}")
        levels[k] = level
    kept = F.greatest(F.col("kinds") - discount, F.lit(0.0))
    all_kinds = levels[1].agg(F.sum("kinds").alias("total"))
    shared = levels[1].crossJoin(F.broadcast(all_kinds)).select(  # a row
        F.col("s1").alias("s"), ((kept + discount) / F.col("total")).alias("shared")
    )
    for k in range(2, order):
        within = levels[k].groupBy(f"c{k - 1}").agg(F.sum("kinds").alias("total"), F.count("*").alias("types"))
        lower = shared.withColumnRenamed("s", f"s{k - 1}")
        joined = levels[k].join(within.hint("merge"), f"c{k - 1}").join(lower.hint("merge"), f"s{k - 1}")
        own = kept / F.col("total") + discount * F.col("types") / F.col("total") * F.col("shared")
        shared = materialise(joined.select(F.col(f"s{k}").alias("s"), own.alias("shared")), f"shared{k}")
    return shared


def ratios(
    counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT, class_discount: float = CLASS_DISCOUNT
) -> DataFrame:
    """(gram, ratio): log ratio toxic to ordinary of each counted string's last character after the others.

    Both classes pass the larger of their two shares down, so that what is new to the smaller class doesn't
    look like the other. `counts` is a written table from `gram_counts`.
    """
    context, below = f"c{order - 1}", f"s{order - 1}"
    sides = {"both": (F.col("toxic") + F.col("ordinary"), discount)} | {n: (F.col(n), class_discount) for n in ("toxic", "ordinary")}

    def kept(side: str) -> Column:
        n, less = sides[side]
        return F.greatest(n - less, F.lit(0.0))

    sums = [F.sum(n).alias(f"{side}_total") for side, (n, _) in sides.items()]
    sums += [F.sum(kept(side)).alias(f"{side}_left") for side in sides]
    within = counts.groupBy(context).agg(*sums)
    lower = _shared(counts, order, discount).withColumnRenamed("s", below)
    joined = counts.join(within.hint("merge"), context).join(lower.hint("merge"), below)

    def evidence(side: str) -> tuple[Column, Column]:
        """The share of discounted counts within the context, and the share that the context passes down."""
        total, left = F.col(f"{side}_total"), F.col(f"{side}_left")
        passed = F.when(total > 0, 1 - left / F.greatest(total, F.lit(1))).otherwise(1.0)
        return kept(side) / F.greatest(left, F.lit(1e-9)), passed

    (own, passed), (toxic, first), (ordinary, second) = map(evidence, ("both", "toxic", "ordinary"))
    joined = joined.select(
        "gram", ((1 - passed) * own + passed * F.col("shared")).alias("pooled"),
        toxic.alias("t"), ordinary.alias("o"), F.greatest(first, second).alias("down"),
    )
    return joined.select("gram", F.expr("ln((1 - down) * t + down * pooled) - ln((1 - down) * o + down * pooled)").alias("ratio"))


class Scorer:
    """Per-word log ratios of texts beyond the margin; keeps those of words it has met."""

    def __init__(self, grams: np.ndarray, ratio: np.ndarray):
        self.grams, self.ratio = np.append(grams, np.iinfo(np.int64).max), np.append(ratio, 0.0)  # grams in order
        self.known: dict[bytes, float] = {}

    def learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), WORDS):
            some = words[i : i + WORDS]
            hashes, word, _, _ = windows([w.decode() for w in some])
            at = np.searchsorted(self.grams, hashes)
            ratio = np.where(self.grams[at] == hashes, self.ratio[at], 0.0)  # 0 for strings not met
            found = np.bincount(word, weights=ratio, minlength=len(some))
            self.known.update(zip(some, np.maximum(found - MARGIN, 0.0).tolist()))

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """Log of the mean excess of each text's words; a text without words has none."""
        out = np.zeros(len(texts))
        for i, j in slices(texts):
            if len(self.known) > KEPT_WORDS:
                self.known.clear()
            cut = [t.split() for t in texts[i:j]]
            new = set().union(*cut).difference(self.known)
            if new:
                self.learn(list(new))
            get = self.known.__getitem__
            for k, words in enumerate(cut, i):
                if words:
                    out[k] = sum(map(get, words)) / len(words)
        return np.log(FLOOR + out)


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    """docs (doc_id, text) with `block`: ranges of ids with about `size` bytes of text; rows without id by text."""
    found = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-found // size) or 1
    inner = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    splits = [-float("inf"), *sorted(set(inner)), float("inf")]
    if len(splits) < 3:  # a block only
        return docs.withColumn("block", F.lit(0).cast("long"))
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    keyed = Bucketizer(splits=splits, inputCol="_id", outputCol="_range").transform(keyed)
    spare = F.pmod(F.xxhash64("text"), F.lit(n))
    return keyed.select(*docs.columns, F.when(F.col("doc_id").isNull(), spare).otherwise(F.col("_range")).cast("long").alias("block"))


def _block_grams(rows: DataFrame) -> DataFrame:
    """(block, gram): the distinct strings of the documents of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, block = payload(batch.column("text")), batch.column("block").to_numpy()
            for b in np.unique(block).tolist():
                some = [texts[i] for i in np.flatnonzero(block == b).tolist()]
                met = set()
                for text in some:
                    met.update(text.split())
                words = list(met)
                parts = [np.unique(windows([w.decode() for w in words[i : i + WORDS]])[0]) for i in range(0, len(words), WORDS)]
                if parts:
                    grams = np.unique(np.concatenate(parts))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), b)), pa.array(grams)], ["block", "gram"])

    return map_batches(rows.select("block", "text"), run, "block long, gram long").distinct()


def differences(docs: DataFrame, ratio: DataFrame, *columns: str, size: int = BLOCK_BYTES) -> DataFrame:
    """`columns` of docs with `difference`, from a table of log ratios (gram, ratio)."""
    rows = _blocks(docs, size)
    known = _block_grams(rows).join(ratio.where("ratio <> 0").hint("merge"), "gram")
    told = known.withColumn("part", F.lit(0)).unionByName(rows.withColumn("part", F.lit(1)), allowMissingColumns=True)
    met = told.repartition("block").sortWithinPartitions("block", "part", "gram")  # a block's strings come first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, scorer = None, [], None
        for batch in batches:
            key = 2 * batch.column("block").to_numpy() + batch.column("part").to_numpy()
            first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]).tolist()
            for i, j in zip(first, first[1:]):
                if i == j:
                    continue
                block, part = divmod(int(key[i]), 2)
                if block != now:
                    now, held, scorer = block, [], None
                rows = batch.slice(i, j - i)
                if not part:
                    held.append((rows.column("gram").to_numpy(zero_copy_only=False), rows.column("ratio").to_numpy(zero_copy_only=False)))
                    continue
                if scorer is None:
                    none = (np.zeros(0, np.int64), np.zeros(0))
                    scorer = Scorer(*(np.concatenate(side) for side in zip(none, *held)))
                    held = []
                found = scorer.differences(payload(rows.column("text")))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(found)], [*columns, "difference"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_batches(met.select(*dict.fromkeys(["block", "part", "gram", "ratio", *columns, "text"])), run, f"{kinds}, difference double")


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a slight ridge."""
    mean, scale = x.mean(), x.std() + 1e-12
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    pull = np.array([ridge, 1e-9])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        bend = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(pull)
        step = np.linalg.solve(bend, z.T @ (p - y) / len(y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from `THRESHOLD` on).

    Learned from rows of `labels` (doc_id, toxic) that aren't held out; a doc_id with several labels counts
    as toxic if one says so, null labels are left out. Without training rows of both classes every score is
    0. Only texts are scored: copies get one score, null and empty texts that of a difference of 0. Repeated
    rows and null doc_ids are passed on. Other columns of `docs` are not read. An empty table gives an empty
    one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    truth = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    held, fit = crc_of_id() % 3 == 1, F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(HELD)) == 0
    usable = docs.where(~held & ~fit).join(truth.hint("merge"), "doc_id")  # the same plan at every size
    counts = materialise(gram_counts(usable), "counts")
    sums = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not all(sums):
        return docs.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    ratio = materialise(ratios(counts), "ratios")
    found = materialise(differences(docs, ratio, "doc_id").withColumn("held_out", held), "differences")
    some = found.where(~F.col("held_out") & fit).join(truth.hint("merge"), "doc_id").select("doc_id", "toxic", "difference")
    sample = some.orderBy(F.xxhash64(F.lit(5), "doc_id")).limit(MOST_FIT).toArrow()
    x, y = sample.column("difference").to_numpy(), sample.column("toxic").to_numpy().astype(np.float64)
    slope, offset = curve(x, y) if len(set(y.tolist())) == 2 else (1.0, 0.0)
    logit = F.col("difference") * F.lit(slope) + F.lit(offset)
    scored = found.withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
