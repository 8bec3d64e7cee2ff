"""Mixing sources to target weights.

The words of each source, documents in the order of a hash of their id, are packed into blocks of fixed
length. A source owes the mix its target in words: whole rounds through all its blocks, then as many blocks of
one more round as the rest needs, the last of them in part. These slots are dealt to output shards by a
multinomial draw, so every shard holds sources in about the target shares and the totals are met exactly. A
keyed pseudorandom permutation of the block numbers (a Feistel network, walked until it falls inside the range)
says which block a slot takes, a new permutation in every round through the source. Slots and blocks are then
joined by block number: `mixed_shards` puts the shards together, `mix_table` adds up what they hold of each
document.

No task sees a whole source: places of documents come from sums over `CHUNKS` hash ranges of a source, slots
are made in ranges of `SLOTS`, dealt to as many tasks, and blocks are counted before the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.llm.base import WORD, map_batches, payload, set_aside, ship
from lodgetier.operators.features import ordinal_codes
from lodgetier.runtime import materialise

BLOCK_WORDS = 32
SHARDS = 64
SHARE = 1.5
MOST_TIMES = 2
WEIGHTS = (3.0, 1.0, 2.0)

#: Hash ranges of a source whose sizes are added up first, and slots made in one go.
CHUNKS = 4_096
SLOTS = 1 << 16

#: Tasks that make slots, at most; each makes its ranges one after the other.
SLOT_TASKS = 4_096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, chunk, place): words of every row, and its place in the order of its source."""
    source = F.col("source").cast("string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.xxhash64(F.lit(7), F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))))
    return docs.select(
        F.col("doc_id").cast("long"), source.alias("source"), size.alias("size"),
        F.pmod(place, F.lit(CHUNKS)).cast("int").alias("chunk"), place.alias("place"),
    )


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, target): words each source gives to the mix.

    Sources in code point order, null last, have the weights in turn; their shares of `share` times all words
    are cut at `most_times` their size, and what is cut goes to the others by weight until none is above.
    Sources are numbered range by range, so there may be any number of them.
    """
    sources = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    codes = ordinal_codes(sources, "source")
    named = sources.count() - sources.where("source is null").count()
    turn = F.coalesce("code", F.lit(named))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    numbered = sources.join(codes.withColumnRenamed("value", "source"), "source", "left")
    table = materialise(numbered.select("source", "source_size", weight.alias("weight")), "sources")
    whole = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    limit = F.col("source_size") * most_times
    level = 0.0  # words per unit of weight
    while True:
        over = F.col("weight") * F.lit(level) >= limit
        cut, free = table.agg(
            F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        higher = (whole - (cut or 0.0)) / free if free else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with `start`, the words of their source before them."""
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("held"))
    ordered = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("source").alias("_s"), F.col("chunk").alias("_c"),
        F.coalesce(F.sum("held").over(ordered), F.lit(0)).alias("before"),
    )
    inner = Window.partitionBy("source", "chunk").orderBy("place", "doc_id", "size")
    own = F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c"))
    return (
        rows.withColumn("inner", own).withColumn("row", F.row_number().over(inner))
        .join(before, same).withColumn("start", F.col("before") + F.col("inner"))
        .drop("_s", "_c", "before", "inner")
    )


def _seed(source: str | None, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{source!r}".encode()).digest()[:8], "little")


def permuted(index: np.ndarray, n: int, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1 for each key, at `index`: four rounds, walked into range.

    `back` undoes it.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))

    def mixed(side: np.ndarray, k: np.ndarray, turn: int) -> np.ndarray:
        value = (side + k + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return (value >> np.uint64(32)) & mask

    while len(todo):
        left, right, k = out[todo] >> shift, out[todo] & mask, key[todo]
        for turn in range(4):
            if back:
                left, right = right ^ mixed(left, k, 3 - turn), left
            else:
                left, right = right, left ^ mixed(right, k, turn)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _round_key(base: int, rounds: np.ndarray) -> np.ndarray:
    return (rounds.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95) ^ np.uint64(base)


def owed_slots(size: int, words: int, block_words: int, base: int) -> tuple[int, int]:
    """(slots, words of the last slot) that give `words` of a source of `size` words exactly."""
    n = -(-size // block_words)
    rounds, rest = divmod(words, size)
    if not rest:
        return rounds * n, size - (n - 1) * block_words if n == 1 else block_words
    short = n * block_words - size  # what the last block lacks, missing once its slot has come
    at = int(permuted(np.array([n - 1]), n, _round_key(base, np.array([rounds])), back=True)[0])
    slots = -(-rest // block_words)
    if at < slots:
        slots = -(-(rest + short) // block_words) if rest > at * block_words + block_words - short else at + 1
    before = (slots - 1) * block_words - (short if at < slots - 1 else 0)
    return rounds * n + slots, rest - before


def slots(goals: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """(source, shard, slot, round, block, words): what each slot of the mix takes, the first `words` of a block."""
    ship(goals.sparkSession)
    words = F.round("target").cast("long")
    owing = goals.withColumn("words", words).where("source_size > 0 and words > 0")
    most = F.expr(f"(words + source_size) div {block_words} + 2")  # slots at most, in ranges
    ranges = owing.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(most / SLOTS))))
    ranges = ranges.select("source", "source_size", "words", "part")
    tasks = owing.agg(F.sum(F.floor(most / SLOTS) + 1)).first()[0] or 1
    ranges = ranges.repartition(int(min(tasks, SLOT_TASKS)), "source", "part")  # a given number stays under adaptive execution

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, size, words, part in frame.itertuples(index=False):
                base = _seed(source, seed)
                n = -(-size // block_words)
                total, last = owed_slots(int(size), int(words), block_words, base)
                counts = np.random.default_rng(base).multinomial(total, np.full(shards, 1 / shards))
                slot = np.arange(part * SLOTS, min(total, (part + 1) * SLOTS), dtype=np.int64)
                rounds = slot // n
                block = permuted(slot % n, int(n), _round_key(base, rounds))
                held = np.where(block == n - 1, size - (n - 1) * block_words, block_words)
                taken = np.where(slot == total - 1, np.minimum(held, last), held)
                yield pd.DataFrame({
                    "source": pd.Series([source] * len(slot), dtype=object),
                    "shard": np.searchsorted(np.cumsum(counts), slot, side="right").astype(np.int32),
                    "slot": slot, "round": rounds.astype(np.int32), "block": block, "words": taken.astype(np.int64),
                })

    return ranges.mapInPandas(run, "source string, shard int, slot long, round int, block long, words long")


def _pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """One row for each document and block that share words; begin and end count words of the document."""
    last = (F.col("start") + F.col("size") - 1)
    span = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    cut = rows.where("size > 0").withColumn("block", F.explode(span))
    begin = F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    return cut.where(last >= 0).withColumn("begin", begin).withColumn("end", end)


class Mix:
    """A mix of documents: its targets, the slots, and what each document gives."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 42):
        self.block_words = block_words
        rows = materialise(sized(docs), "sizes")
        self.targets = materialise(targets(rows, weights, share), "targets")
        self.rows = materialise(_numbered(rows), "places")
        self.slots = slots(self.targets, block_words, shards, seed)
        self.pieces = _pieces(self.rows, block_words)

    def drawn(self) -> DataFrame:
        """Pieces of documents with `times`, the number of slots that take them."""
        full = F.least(F.lit(self.block_words), F.col("source_size") - F.col("block") * self.block_words)
        sizes = self.targets.select(F.col("source").alias("_of"), "source_size")
        owned = self.slots.join(sizes, F.col("source").eqNullSafe(F.col("_of")))
        taken = owned.groupBy("source", "block").agg(
            F.count_if(F.col("words") >= full).alias("whole"), F.coalesce(F.max(F.when(F.col("words") < full, F.col("words"))), F.lit(0)).alias("part")
        )
        taken = taken.withColumnsRenamed({"source": "_s", "block": "_b"})
        same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
        met = self.pieces.join(taken.hint("merge"), same).drop("_s", "_b")  # it grows with the mix: no broadcast
        cut = F.greatest(F.col("begin"), F.least(F.col("end"), F.col("block") * self.block_words + F.col("part") - F.col("start")))
        both = F.array(
            F.struct(F.col("begin").alias("from"), cut.alias("to"), (F.col("whole") + 1).alias("times")),
            F.struct(cut.alias("from"), F.col("end").alias("to"), F.col("whole").alias("times")),
        )
        parts = met.withColumn("piece", F.explode(both)).drop("begin", "end", "whole", "part")
        parts = parts.withColumns({"begin": F.col("piece.from"), "end": F.col("piece.to"), "times": F.col("piece.times")}).drop("piece")
        return parts.where("begin < end and times > 0")


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, with repeats).

    A null source is a source of its own, last in order. Null and empty texts have size 0 and give nothing; a
    source without words has target 0. Copies are documents like any other. Rows that agree in doc_id, source
    and text are numbered and each returned. A null doc_id is passed on. Columns but doc_id, text and source
    are not read. An empty table gives an empty one. Reruns give the same rows.
    """
    mix = Mix(docs)
    key = ["source", "chunk", "row"]
    given = mix.drawn().groupBy(*key).agg(F.sum((F.col("end") - F.col("begin")) * F.col("times")).alias("taken"))
    given = given.withColumnsRenamed({k: f"_{k}" for k in key})
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")) & (F.col("row") == F.col("_row"))
    goals = mix.targets.withColumnRenamed("source", "_s")
    return (
        mix.rows.join(given, same, "left").join(goals, F.col("source").eqNullSafe(F.col("_s")), "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of `docs`: for each document and time, the words it gives.

    A document drawn in part keeps the drawn runs of words in their order, white space within a run as it
    was and one space between runs; drawn twice, it appears twice, the second time with the words drawn twice.
    Documents without a drawn word are left out. n_chars follows the text. Rows that agree in doc_id, source
    and text give the sum of what each gives. Other columns may have any name and type.
    """
    docs, named = set_aside(docs, "doc_id", "text", "source", "n_chars")
    rows = Mix(docs).drawn().groupBy("doc_id", "source", "place").agg(
        F.collect_list(F.struct("begin", "end", "times")).alias("_runs")
    )
    met = _with_lists(docs, rows)

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = [], []
            for i, (text, runs) in enumerate(zip(payload(batch.column("text")), batch.column("_runs").to_pylist())):
                for some in _times(runs):
                    at.append(i)
                    texts.append(_take(text, some))
            taken = batch.take(pa.array(at, pa.int64()))
            columns = {n: taken.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(taken.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return named(map_batches(met, run, docs.schema))


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents with the lists (doc_id, source, place, ...) of their own."""
    lists = lists.withColumnsRenamed({"doc_id": "_id", "source": "_source", "place": "_mark"})
    mark = F.xxhash64(F.lit(7), F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))))
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (mark == F.col("_mark"))
    )
    return docs.join(lists, same).drop("_id", "_source", "_mark")


def mixed_shards(docs: DataFrame, **settings) -> DataFrame:
    """(shard, place, source, slot, text): the output shards put together, a row for each slot.

    The slots of a shard are numbered from 0 in the order of a hash, so its sources are mixed; text is the
    words of the slot's block, joined by spaces.
    """
    docs = docs.select("doc_id", "source", "text")
    mix = Mix(docs, **settings)
    block_words = mix.block_words
    inner = F.col("start") + F.col("begin") - F.col("block") * block_words
    lists = mix.pieces.groupBy("doc_id", "source", "place").agg(
        F.collect_list(F.struct("row", "block", inner.alias("inner"), "begin", "end")).alias("_runs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (i, r["row"], r["block"], r["inner"], _take(text, [(r["begin"], r["end"])]))
                for i, (text, runs) in enumerate(zip(payload(batch.column("text")), batch.column("_runs").to_pylist()))
                for r in runs
            ]
            owner, row, block, inside, texts = (list(c) for c in zip(*found)) if found else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("source").take(pa.array(owner, pa.int64())), pa.array(row, pa.int32()),
                    pa.array(block, pa.int64()), pa.array(inside, pa.int64()), pa.array(texts, pa.string()),
                ],
                ["source", "row", "block", "inner", "text"],
            )

    # Rows that agree in id, source and text meet each list once per row; a piece is told by its row number.
    cut = map_batches(_with_lists(docs.distinct(), lists), run, "source string, row int, block long, inner long, text string")
    parts = F.array_sort(F.collect_list(F.struct("inner", "row", "text")))  # the words of a block at most
    whole = cut.groupBy("source", "block").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
    whole = whole.withColumnsRenamed({"source": "_s", "block": "_b"})
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    first = F.array_join(F.slice(F.split("text", r"[\x20\x09-\x0D]+"), F.lit(1), F.col("words").cast("int")), " ")
    order = Window.partitionBy("shard").orderBy(F.xxhash64("source", "slot"), "source", "slot")
    return mix.slots.join(whole.hint("merge"), same).select(
        "shard", (F.row_number().over(order) - 1).alias("place"), "source", "slot", first.alias("text")
    )


def _times(runs: list[dict]) -> list[list[tuple[int, int]]]:
    """Runs of words taken at least once, at least twice and so on, neighbours joined."""
    out = []
    for k in range(1, max(r["times"] for r in runs) + 1):
        joined: list[tuple[int, int]] = []
        for begin, end in sorted((r["begin"], r["end"]) for r in runs if r["times"] >= k):
            if joined and joined[-1][1] == begin:
                joined[-1] = (joined[-1][0], end)
            else:
                joined.append((begin, end))
        out.append(joined)
    return out


def _take(text: bytes, runs: list[tuple[int, int]]) -> str:
    """The runs of words of a text, counted in words."""
    if len(runs) == 1 and runs[0] == (0, len(text.split())):
        return text.decode()
    data = np.frombuffer(text, dtype=np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return b" ".join(text[starts[b] : ends[e - 1]] for b, e in runs).decode()
