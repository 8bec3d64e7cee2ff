"""Phrase collocations counted with counting quotient filters.

1. Texts are cut into pieces and words, and written in blocks: the codes of the words of a block, breaks
   between pieces as code 0, and the block's own dictionary with counts.
2. Dictionaries are added up per language; words that reach the least count of a candidate get a global
   number, the others can be in no candidate and count as breaks. Numbers go back to the blocks by a join of
   their dictionaries, so no dictionary is held whole anywhere.
3. A task counts the n-grams of its blocks. An n-gram's word numbers, packed side by side, are permuted by a
   Feistel network on just as many bits. The high bits of the result are the quotient, the low bits the full
   remainder, so that nothing is lost: a filter keeps how many remainders each quotient has, the remainders in
   order, and their counters. The first bits of the quotient are the bucket that a filter goes to.
4. A bucket's filters from all tasks are merged, counters of equal remainders added up. Counters that reach
   the least count are turned back into word numbers. Permuted keys are spread evenly, whatever the text.
5. Scores are joins of these counts, in whole numbers of 38 digits.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, payload, slices
from lodgetier.runtime import materialise, small_or_spread_join

LEAST = 10
TOP = 2_000
NO_LANGUAGE = "und"

#: A longer candidate drops what it contains from this percentage of its count on.
CONTAINED_PERCENT = 50

#: Bytes of text in a block; counters that a task merges before it passes them on; n-grams a bucket is made for.
BLOCK_BYTES = 4 << 20
HELD = 1 << 21
BUCKET = 1 << 19

_BREAK = b"\xff"  # in no UTF-8 text
_LETTERS = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\n\v\f\r", bytes(range(97, 123)) + _BREAK * 10
)


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of some texts with a break between pieces, so between texts too."""
    return _BREAK.join(texts).translate(_LETTERS).replace(_BREAK, b" \xff ").split()


class Block:
    """Codes of the words of some texts of one language, code 0 for breaks."""

    def __init__(self):
        self.codes: list[np.ndarray] = []
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.index[_BREAK]  # code 0
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        found = words_of(texts)
        self.codes.append(np.fromiter(map(self.index.__getitem__, found), np.uint32, len(found)))
        self.codes.append(np.zeros(1, dtype=np.uint32))
        self.size += sum(map(len, texts)) + 1

    def row(self) -> tuple[list[bytes], list[int], bytes]:
        """Words, their counts, and the codes; words have the codes 1, 2, ..."""
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes, minlength=len(self.index))[1:]
        return list(self.index)[1:], counts.tolist(), codes.tobytes()


_BLOCK = "block long, lang string, n long, words array<string>, counts array<long>, codes binary"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, n, words, counts, codes): all texts, language by language, in blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, number = TaskContext.get().partitionId() << 32, defaultdict(Block), 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang, block in held.items():
                words, counts, codes = block.row()
                row = [made + number, lang, sum(counts), words, counts, codes]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _BLOCK.split(", ")]
                )
                number += 1
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            texts = payload(batch.column("text"))
            for i, j in slices(texts, max(1, block_bytes // 4)):
                by_lang: defaultdict[str, list[bytes]] = defaultdict(list)
                for lang, text in zip(langs[i:j], texts[i:j]):
                    by_lang[lang].append(text)
                for lang, some in by_lang.items():
                    held[lang].add(some)
                if sum(b.size for b in held.values()) >= block_bytes:
                    yield from closed()
        yield from closed()

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))
    return map_batches(docs.select(lang.alias("lang"), "text"), run, _BLOCK)


def _entries(written: DataFrame) -> DataFrame:
    """(block, lang, pos, word, n) of all blocks' dictionaries; pos from 0."""
    both = F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "entry")
    return written.select("block", "lang", both).select("block", "lang", "pos", F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))


def dictionary(written: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, f, id): words found `least` times or more in a language, numbered from 1."""
    counted = _entries(written).groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(counted.withColumns({"part": F.spark_partition_id(), "inside": inside}), "words")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row per task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return materialise(
        placed.join(F.broadcast(offsets), "part").select("lang", "word", "f", (F.col("before") + F.col("inside") + 1).alias("id")), "dictionary"
    )


class Permutation:
    """An invertible scrambling of three packed word numbers of `width` bits, held as two halves."""

    ROUNDS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

    def __init__(self, width: int):
        if width > 42:
            raise ValueError("more words than 42 bits can number")
        self.width, self.half = width, (3 * width + 1) // 2
        self.mask = np.uint64((1 << self.half) - 1)

    def _mixed(self, half: np.ndarray, turn: int) -> np.ndarray:
        value = (half + np.uint64(turn + 1)) * np.uint64(self.ROUNDS[turn])
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xC2B2AE3D27D4EB4F)
        return (value ^ (value >> np.uint64(32))) & self.mask

    def forward(self, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, cut = np.uint64(self.width), np.uint64(self.half - self.width)  # the second number lies across the middle
        one, two, three = (a.astype(np.uint64) for a in (one, two, three))
        low = three | ((two & ((np.uint64(1) << cut) - np.uint64(1))) << w)
        high = (two >> cut) | (one << (w - cut))
        for turn in range(len(self.ROUNDS)):
            high, low = low, high ^ self._mixed(low, turn)
        return high, low

    def back(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for turn in reversed(range(len(self.ROUNDS))):
            high, low = low ^ self._mixed(high, turn), high
        w, cut = np.uint64(self.width), np.uint64(self.half - self.width)
        number = (np.uint64(1) << w) - np.uint64(1)
        two = (low >> w) | ((high & ((np.uint64(1) << (w - cut)) - np.uint64(1))) << cut)
        return tuple(a.astype(np.int64) for a in (high >> (w - cut), two & number, low & number))


def _in_order(high: np.ndarray, low: np.ndarray, half: int) -> np.ndarray:
    return np.argsort(high << np.uint64(half) | low, kind="stable") if 2 * half <= 64 else np.lexsort((low, high))


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (high, low) of all parts with the sums of their counters."""
    high, low, count = (np.concatenate(c) for c in zip(*parts))
    order = _in_order(high, low, half)
    high, low, count = high[order], low[order], count[order]
    fresh = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))[: len(high)]
    at = np.flatnonzero(fresh)
    return high[at], low[at], np.add.reduceat(count, at) if len(at) else count


def _small(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as few bytes each as the largest needs."""
    top = int(values.max()) if len(values) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s))
    return size, values.astype(f"<u{size}").tobytes()


def to_filter(high: np.ndarray, low: np.ndarray, count: np.ndarray, bucket_bits: int, half: int) -> bytes:
    """A counting quotient filter of one bucket's sorted keys: run lengths by quotient, remainders, counters."""
    bits = min(half - bucket_bits, max(0, len(high).bit_length() - 1))
    rest = np.uint64(half - bucket_bits - bits)
    quotient = (high >> rest) & np.uint64((1 << bits) - 1)
    remainder = high & ((np.uint64(1) << rest) - np.uint64(1))
    runs = np.bincount(quotient.astype(np.int64), minlength=1 << bits)
    packed = [_small(a) for a in (runs, remainder, low, count)]
    return struct.pack("<IBBBBB", len(high), bits, *(size for size, _ in packed)) + b"".join(data for _, data in packed)


def from_filter(data: bytes, bucket: int, bucket_bits: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted keys and counters of a filter."""
    n, bits, *sizes = struct.unpack_from("<IBBBBB", data)
    at, arrays = struct.calcsize("<IBBBBB"), []
    for size, length in zip(sizes, (1 << bits, n, n, n)):
        arrays.append(np.frombuffer(data, f"<u{size}", length, at).astype(np.uint64))
        at += size * length
    runs, remainder, low, count = arrays
    rest = np.uint64(half - bucket_bits - bits)
    quotient = np.repeat(np.arange(1 << bits, dtype=np.uint64), runs.astype(np.int64))
    high = (np.uint64(bucket) << np.uint64(half - bucket_bits)) | (quotient << rest) | remainder
    return high, low, count.astype(np.int64)


def counted_ngrams(codes: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(one, two, three, count) of distinct pairs, `one` being 0, and triples of neighbouring words with an id."""
    used = np.unique(ids)
    used = used[used > 0]
    local = np.searchsorted(used, ids) + 1
    local[ids == 0] = 0
    code, base = local[codes], len(used) + 1
    numbers = np.append(0, used)
    sound = code > 0
    pair = np.flatnonzero(sound[:-1] & sound[1:])
    key, count = np.unique(code[pair] * base + code[pair + 1], return_counts=True)
    found = [(np.zeros(len(key), dtype=np.int64), numbers[key // base], numbers[key % base], count)]
    triple = pair[:-1][pair[1:] == pair[:-1] + 1]
    pairs = np.searchsorted(key, code[triple] * base + code[triple + 1])  # numbered again, so that 64 bits hold a triple
    three, count = np.unique(pairs * base + code[triple + 2], return_counts=True)
    first = key[three // base] if len(three) else three
    found.append((numbers[first // base], numbers[first % base], numbers[three % base], count))
    return found


def filters(written: DataFrame, words: DataFrame, width: int, bucket_bits: int) -> DataFrame:
    """(bucket, data): the counting quotient filters of the n-grams of all blocks."""
    numbers = _entries(written).join(words.select("lang", "word", "id").hint("merge"), ["lang", "word"])
    known = numbers.groupBy("block").agg(F.collect_list("pos").alias("at"), F.collect_list("id").alias("ids"))
    sized = written.select("block", F.size("words").alias("n_words"), "codes").join(known.hint("merge"), "block")
    shuffle = Permutation(width)
    half = shuffle.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def passed_on() -> Iterator[pa.RecordBatch]:
            high, low, count = merged(held, half)
            bucket = (high >> np.uint64(half - bucket_bits)).astype(np.int64)
            ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
            for i in range(0, len(ends), 256):
                cuts = list(zip([ends[i - 1] if i else 0, *ends[i : i + 255].tolist()], ends[i : i + 256].tolist()))
                data = [to_filter(high[a:b], low[a:b], count[a:b], bucket_bits, half) for a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in cuts]]), pa.array(data, pa.binary())], ["bucket", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.zeros(row.column("n_words")[0].as_py() + 1, dtype=np.int64)
                ids[row.column("at").flatten().to_numpy() + 1] = row.column("ids").flatten().to_numpy()
                for one, two, three, count in counted_ngrams(np.frombuffer(row.column("codes")[0].as_buffer(), "<u4"), ids):
                    held.append((*shuffle.forward(one, two, three), count))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged(held, half)]
                    if len(held[0][0]) > HELD // 2:
                        yield from passed_on()
                        held = []
        if any(len(h[0]) for h in held):
            yield from passed_on()

    return map_batches(sized, run, "bucket long, data binary")


def merged_counts(found: DataFrame, width: int, bucket_bits: int, least: int = LEAST) -> DataFrame:
    """(one, two, three, f) of n-grams found `least` times or more; `one` is 0 for pairs."""
    shuffle = Permutation(width)
    half = shuffle.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now = None

        def closed() -> pa.RecordBatch:
            high, low, count = merged(held, half)
            kept = count >= least
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, shuffle.back(high[kept], low[kept])), pa.array(count[kept])], ["one", "two", "three", "f"]
            )

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if held and bucket != now:
                    yield closed()
                    held = []
                now = bucket
                held.append(from_filter(data.as_buffer(), bucket, bucket_bits, half))
                if len(held) > 1 and sum(len(h[0]) for h in held) > HELD:
                    held = [merged(held, half)]
        if held:
            yield closed()

    return map_batches(found.repartition("bucket").sortWithinPartitions("bucket"), run, "one long, two long, three long, f long")


class Counts:
    """Exact counts of words and of all phrases of two and three words that reach the least count."""

    def __init__(self, docs: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET):
        written = materialise(blocks(docs, block_bytes), "blocks")
        self.totals = written.groupBy("lang").agg(F.sum("n").alias("n"))
        self.words = dictionary(written, least)
        top, ngrams = self.words.agg(F.max("id")).first()[0] or 0, 2 * (written.agg(F.sum("n")).first()[0] or 0)
        width = max(2, top.bit_length())
        bits = min(Permutation(width).half, max(0, (ngrams // bucket).bit_length()))
        made = materialise(merged_counts(filters(written, self.words, width, bits), width, bits, least), "ngrams")
        self.pairs = made.where("one = 0").select("two", "three", "f")
        self.triples = made.where("one > 0")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly: counts of up to 15 digits give products of up to 37."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def candidates(counts: Counts, contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
    """(lang, one, two, three, a, l, r, score) of candidates that no longer one drops; `three` is null for pairs."""
    words = counts.words.select("id", "f")
    pairs, triples = counts.pairs, counts.triples

    def word(name: str, column: str) -> DataFrame:
        return words.select(F.col("id").alias(column), F.col("f").alias(name))

    heads = pairs.select(F.col("two").alias("one"), F.col("three").alias("two"), F.col("f").alias("f12"))
    tails = pairs.select("two", "three", F.col("f").alias("f23"))
    long = triples.join(heads, ["one", "two"]).join(tails, ["two", "three"]).join(word("f1", "one"), "one").join(word("f3", "three"), "three")
    cuts = [(F.col("f1"), F.col("f23")), (F.col("f12"), F.col("f3"))]
    first, second = (_score(F.col("f"), left, right) for left, right in cuts)
    long = long.select("one", "two", "three", "f", first.alias("s1"), second.alias("s2"), "f1", "f23", "f12", "f3")
    early = F.col("s1") <= F.col("s2")
    long = long.select(
        "one", "two", "three", F.col("f").alias("a"), F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    holding = triples.select(F.col("one").alias("x"), F.col("two").alias("y"), "f").unionByName(
        triples.select(F.col("two").alias("x"), F.col("three").alias("y"), "f")
    )
    most = holding.groupBy(F.col("x").alias("one"), F.col("y").alias("two")).agg(F.max("f").alias("most"))
    short = heads.withColumnRenamed("f12", "a").join(most, ["one", "two"], "left")
    short = short.where(F.col("most").isNull() | (100 * F.col("most") < contained_percent * F.col("a")))
    short = short.join(word("l", "one"), "one").join(word("r", "two"), "two")
    short = short.select("one", "two", F.lit(None).cast("long").alias("three"), "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    langs = counts.words.select(F.col("id").alias("one"), "lang")
    return long.unionByName(short).join(langs, "one")


def phrase_table(docs: DataFrame, least: int = LEAST, top: int = TOP, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    A null language is `und`, like a language of that name. Null and empty texts have no words. Copies and
    repeated rows count each. Ties in score and count are ordered by phrase. Columns but text and lang are not
    read. An empty table, or one without candidates, gives an empty one.
    """
    counts = Counts(docs, least, block_bytes, bucket)
    scored = materialise(candidates(counts), "candidates")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    last = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    last = materialise(last.groupBy("lang").agg(F.min(F.struct("score", "a")).alias("last")), "last")  # the top-th of a language; its ties go on
    kept = small_or_spread_join(scored, last, ["lang"], "inner").where(F.struct("score", "a") >= F.col("last")).drop("last")
    names = counts.words.select("id", "word")
    for k, column in enumerate(("one", "two", "three")):
        kept = kept.join(names.select(F.col("id").alias(column), F.col("word").alias(f"w{k}")), column, "left")
    phrase = F.concat_ws(" ", "w0", "w1", "w2")  # leaves a null third word out
    ranked = kept.withColumn("phrase", phrase).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    )
    ranked = ranked.where(F.col("rank") <= top).join(counts.totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
