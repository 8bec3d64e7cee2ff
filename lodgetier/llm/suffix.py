"""Repeated passages by bucket-pointer refinement over sampled suffixes.

To be removed is every byte covered by a string of `length` bytes that starts at two places of the corpus.
Suffixes are sampled so that none is missed: each window of `length` bytes names one suffix inside it as its
anchor, the one whose q-gram (half the length) has the smallest hash, the leftmost of equals. Equal windows
name anchors at equal offsets, so a repeated window's anchors share their q-gram. An anchor thus stands for
a run of windows, and a window belongs to one anchor.

1. Buckets: anchors are put into buckets by their q-gram. A bucket of one is done and leaves.
2. Refinement: a bucket is refined by the identifier of all bytes that an anchor's windows span. Anchors that
   share it are settled: all their windows are repeated. Buckets that hold one such identifier are done.
3. In buckets that split, windows are refined one by one, once for each identifier: a window's bucket is the
   pair of the bucket of the q-gram it starts with and the bucket of the q-gram half a length later, the
   identifiers that step 1 made, reused as pointers at a later offset. The pair covers the window exactly.

Identifiers are 64-bit polynomial hashes; two anchors or windows are held equal only if two of them agree.
Steps 1 and 2 count before the shuffle and join the counts back; rows of the few hot grams and spans are told
by a list of these instead, so copies of a passage meet in no task. In
step 3 a task compares the distinct spans of a bucket; buckets with many have their windows dealt to tasks by
identifier instead. Texts are moved once, to the places of their spans, and read again there in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, payload, set_aside, slices, spread, whole_groups
from lodgetier.llm.chunks import prefix_hashes, range_hashes
from lodgetier.runtime import materialise

LENGTH = 400

#: Bytes hashed at a time; longer texts are cut into overlapping pieces with windows of their own.
PIECE = 1 << 20

#: Distinct spans of a bucket that one task compares; the windows of larger buckets are dealt out.
TOGETHER = 1_024

#: Grams and spans that more than 1/HOT of the anchors share are told by a list instead of a join.
HOT = 1_000

#: How tables of identifiers are written: nothing repeats in them that a dictionary could save, and a task
#: buffers no more than a small row group.
HASHES = {"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}

_LOW = 22  # bits of an anchor's place in a slice; slices are shorter than 2**22


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(number of the text, offset, bytes) with every window in exactly one piece."""
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), PIECE):
            yield i, at, text[at : at + PIECE + length - 1]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of pieces that lie end to end: place, first and last window, q-gram and span identifiers."""
    gram = (length + 1) // 2
    sums = prefix_hashes(data)
    starts = np.arange(len(data) - gram + 1)
    grams = range_hashes(sums, starts, starts + gram)
    mixed = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    low = np.uint64((1 << _LOW) - 1)
    best = _smallest((mixed & ~low) | starts.astype(np.uint64), length - gram + 1) & low
    inside = np.ones(len(best), dtype=bool)
    for end in ends[:-1].tolist():  # a window may not cross the end of a piece
        inside[max(0, end - length + 1) : end] = False
    window = np.flatnonzero(inside)
    at = best[window].astype(np.int64)
    fresh = np.append(True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1))
    first = window[fresh]
    last = window[np.append(fresh[1:], True)]
    at = at[fresh]
    span = range_hashes(sums, first, last + length)
    shape = ((at - first) * length + (at - last)).astype(np.uint64)
    return at, first, last, grams[at], span ^ (shape * np.uint64(0xD1342543DE82EF95))


#: Stands for a null doc_id in keys.
_NONE = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with the key of each text: its doc_id, and a checksum for rows of one doc_id with different texts."""
    return docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("_key"),
        (F.crc32(F.coalesce(F.col("text"), F.lit(""))) - F.lit(1 << 31)).cast("int").alias("_mark"),
    )


def _listed(docs: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """Every row of keyed `docs` with its places as a list, null without any."""
    lists = places.groupBy("key", "mark").agg(F.collect_list(F.struct(*columns)).alias("_runs"))
    same = (F.col("_key") == F.col("key")) & (F.col("_mark") == F.col("mark"))
    return docs.join(lists.hint("merge"), same, "left").drop("key", "mark")


def _runs(column: pa.Array, *fields: str) -> tuple[list[int], list[np.ndarray]]:
    """Ends of the lists of a column of runs, and their fields end to end; a null list is empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return ends.tolist(), [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]


_PLACE = "key long, mark int, first int, last int"


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(gram, span, key, mark, first, last) for every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = list(_pieces(payload(batch.column("text")), length))
            for i, j in slices([p[2] for p in pieces], PIECE):
                some = pieces[i:j]
                sizes = np.array([len(p[2]) for p in some], dtype=np.int64)
                ends = np.cumsum(sizes)
                at, first, last, gram, span = anchors(np.frombuffer(b"".join(p[2] for p in some), dtype=np.uint8), ends, length)
                piece = np.searchsorted(ends, at, side="right")
                move = np.array([p[1] for p in some], dtype=np.int64)[piece] - (ends - sizes)[piece]
                owner = pa.array(np.array([p[0] for p in some])[piece])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), batch.column("_key").take(owner),
                        batch.column("_mark").take(owner), pa.array((first + move).astype(np.int32)), pa.array((last + move).astype(np.int32)),
                    ],
                    ["gram", "span", "key", "mark", "first", "last"],
                )

    return map_batches(docs.select("_key", "_mark", "text"), run, f"gram long, span long, {_PLACE}")


def _spans(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, key, mark, first, single, span): the bytes that wanted anchors' windows span."""
    listed = _listed(docs, wanted, "gram", "first", "last", "single").where("_runs is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, (gram, first, last, single) = _runs(batch.column("_runs"), "gram", "first", "last", "single")
            owner = np.repeat(np.arange(batch.num_rows), np.diff([0, *ends]))
            texts = payload(batch.column("text"))
            sizes = np.cumsum(last.astype(np.int64) - first + length)
            for some in np.split(np.arange(len(owner)), np.searchsorted(sizes, np.arange(PIECE, int(sizes[-1]), PIECE)) if len(sizes) else []):
                if not len(some):
                    continue
                spans = [texts[k][i : j + length] for k, i, j in zip(owner[some].tolist(), first[some].tolist(), last[some].tolist())]
                rows = pa.array(owner[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram[some]), batch.column("_key").take(rows), batch.column("_mark").take(rows),
                        pa.array(first[some]), pa.array(single[some]), pa.array(spans, pa.binary()),
                    ],
                    ["gram", "key", "mark", "first", "single", "span"],
                )

    return map_batches(listed, run, "gram long, key long, mark int, first int, single boolean, span binary")


def window_ids(spans: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, head, tail) of every window of some spans: identifiers of its first and last q-gram."""
    gram = (length + 1) // 2
    sizes = np.array([len(s) for s in spans], dtype=np.int64)
    sums = prefix_hashes(np.frombuffer(b"".join(spans), dtype=np.uint8))
    count = sizes - length + 1
    at = spread(count, np.cumsum(sizes) - sizes)
    row = np.repeat(np.arange(len(spans)), count)
    place = spread(count, np.zeros(len(spans), dtype=np.int64))
    return row, place, range_hashes(sums, at, at + gram), range_hashes(sums, at + length - gram, at + length)


def _smaller(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of whole buckets, cut between buckets into parts of about a quarter of `PIECE`."""
    gram = batch.column("gram").to_numpy(zero_copy_only=False)
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
    sizes = np.cumsum(pc.binary_length(batch.column("span")).to_numpy(zero_copy_only=False))[ends - 1]
    start = done = 0
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if size - done >= PIECE // 4 or end == len(gram):
            yield batch.slice(start, end - start)
            start, done = end, size


def _refined(spans: DataFrame, length: int) -> DataFrame:
    """(key, mark, first, last): repeated windows of single anchors, found bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in whole_groups(batches, "gram") for part in _smaller(whole)):
            gram, first, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "first", "single"))
            row, place, head, tail = window_ids(batch.column("span").to_pylist(), length)
            bucket = gram[row]
            order = np.lexsort((tail, head, bucket))
            same = (bucket[order][1:] == bucket[order][:-1]) & (head[order][1:] == head[order][:-1]) & (tail[order][1:] == tail[order][:-1])
            twice = np.zeros(len(order), dtype=bool)
            twice[order] = np.append(same, False) | np.append(False, same)
            hit = np.flatnonzero(twice & single[row])
            fresh = np.append(True, (np.diff(hit) != 1) | (row[hit][1:] != row[hit][:-1])) if len(hit) else np.zeros(0, bool)
            low, high = hit[fresh], hit[np.append(fresh[1:], True)] if len(hit) else hit
            owner = pa.array(row[low])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(owner), batch.column("mark").take(owner),
                    pa.array((first[row[low]] + place[low]).astype(np.int32)), pa.array((first[row[low]] + place[high]).astype(np.int32)),
                ],
                ["key", "mark", "first", "last"],
            )

    return map_batches(spans.repartition("gram").sortWithinPartitions("gram"), run, _PLACE)


def _dealt(spans: DataFrame, length: int) -> DataFrame:
    """As `_refined`, for buckets of any size: windows are dealt to tasks by their identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans = batch.column("span").to_pylist()
            for i, j in slices(all_spans, PIECE):
                row, place, head, tail = window_ids(all_spans[i:j], length)
                owner = pa.array(row + i)
                at = batch.column("first").to_numpy()[row + i] + place
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(head.view(np.int64)), pa.array(tail.view(np.int64)), batch.column("key").take(owner),
                        batch.column("mark").take(owner), pa.array(at.astype(np.int32)), batch.column("single").take(owner),
                    ],
                    ["head", "tail", "key", "mark", "at", "single"],
                )

    schema = "head long, tail long, key long, mark int, at int, single boolean"
    windows = map_batches(spans, run, schema)  # made twice from texts that are moved once
    twice = windows.groupBy("head", "tail").agg(F.count("*").alias("n")).where("n > 1").select("head", "tail")
    again = windows.where("single").join(twice, ["head", "tail"], "left_semi")
    return again.select("key", "mark", F.col("at").alias("first"), F.col("at").alias("last"))


def _hot(found: DataFrame, keys: list[str], least: float) -> list[tuple]:
    """Keys that more than `least` of some rows have, with whether they hold several spans."""
    low, high = F.min("span"), F.max("span")
    hot = found.groupBy(*keys).agg(F.count("*").alias("n"), (low != high).alias("split")).where((F.col("n") > least) & (F.col("n") > 1))
    return [tuple(r) for r in hot.select(*keys, "split").collect()]


def repeated_spans(docs: DataFrame, length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """(key, mark, first, last) of keyed docs: runs of starts of repeated strings, overlapping or not, in no order.

    A gram, or a span of it, that more than 1/HOT of all anchors have is on a list of fewer than HOT; rows
    of these are told by the list and meet in no join.
    """
    found = materialise(anchor_table(docs, length), "anchors", **HASHES)
    least = found.count() / HOT
    grams = _hot(found, ["gram"], least)
    hot_gram = F.col("gram").isin([g for g, _ in grams])
    split_gram = F.col("gram").isin([g for g, split in grams if split])
    spans = [(g, s) for g, s, _ in _hot(found.where(split_gram), ["gram", "span"], least)]
    pair = F.concat_ws(":", "gram", "span").isin([f"{g}:{s}" for g, s in spans])
    hot_span = F.col("span").isin([s for _, s in spans]) & pair

    usual = found.where(~hot_gram)
    buckets = usual.groupBy("gram").agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
    shared = buckets.where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("split"))
    kept = usual.join(shared.hint("merge"), "gram").unionByName(found.where(hot_gram).withColumn("split", split_gram))
    kept = materialise(kept.withColumn("settled", ~F.col("split") | hot_span), "shared", **HASHES)
    settled = kept.where("settled").select("key", "mark", "first", "last")

    place = F.min(F.struct("key", "mark", "first", "last")).alias("place")
    kinds = materialise(kept.where("split").groupBy("gram", "span").agg(F.count("*").alias("n"), place), "kinds")
    copied = kept.where("not settled").join(kinds.where("n > 1").select("gram", "span").hint("merge"), ["gram", "span"], "left_semi")
    settled = settled.unionByName(copied.select("key", "mark", "first", "last"))

    crowded = materialise(kinds.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > together).select("gram"), "crowded")
    wanted = kinds.select("gram", "place.*", (F.col("n") == 1).alias("single"))
    close = _spans(docs, wanted.join(crowded, "gram", "left_anti"), length)
    found = settled.unionByName(_refined(close, length))
    if not crowded.isEmpty():
        found = found.unionByName(_dealt(_spans(docs, wanted.join(crowded, "gram", "left_semi"), length), length))
    return found


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    """Keyed `docs` with the list of repeated starts of each text, null if it has none."""
    docs = _keyed(docs)
    return _listed(docs, repeated_spans(docs, length), "first", "last")


def _covered(size: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a text are covered by strings that start from `first` to `last`."""
    turn = np.bincount(first, minlength=size + 1) - np.bincount(last + length, minlength=size + 1)
    return np.cumsum(turn[:-1]) > 0


def repeats_table(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans (removed runs), kept_sha256 (of the bytes left).

    `with_text` adds the text left, without the rest of characters that a cut falls inside of.

    A null text counts as empty; a text below `length` bytes loses nothing. Copies lose all that they share,
    the first one too, and repeated rows are copies of each other. Rows with one doc_id and different texts
    are told apart by their texts. Columns but doc_id and text are not read; an empty table gives an empty
    one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, start = [], [], 0
            ends, (first, last) = _runs(batch.column("_runs"), "first", "last")
            for text, end in zip(payload(batch.column("text")), ends):
                if end > start:
                    gone = _covered(len(text), first[start:end], last[start:end], length)
                    start = end
                    kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, spans = text, 0
                rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
                if with_text:
                    texts.append(kept.decode(errors="ignore"))
            columns = [list(c) for c in zip(*rows)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
                + [pa.array(texts, pa.string())] * with_text,
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text,
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return map_batches(_with_runs(narrow, length), run, schema + ", text string" * with_text)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` without the repeated bytes of their texts, all rows and columns kept; n_chars follows the text.

    Where a cut falls inside a character its left bytes are dropped. A text that is repeated as a whole
    becomes empty; a null text stays null. Other columns may have any name and type.
    """
    docs, named = set_aside(docs, "doc_id", "text", "n_chars")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column("text").to_pylist(), 0
            ends, (first, last) = _runs(batch.column("_runs"), "first", "last")
            for i, end in enumerate(ends):
                if end > start:
                    raw = texts[i].encode()
                    gone = _covered(len(raw), first[start:end], last[start:end], length)
                    texts[i] = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes().decode(errors="ignore")
                    start = end
            columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                sizes = [None if t is None else len(t) for t in texts]
                columns["n_chars"] = pa.array(sizes, pa.int64()).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return named(map_batches(_with_runs(docs, length), run, docs.schema))
