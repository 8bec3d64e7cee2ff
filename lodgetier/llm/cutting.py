"""Packing documents into sequences of a fixed length by cutting-stock column generation.

A document is cut into pieces of the sequence length and a rest. The histogram of piece lengths is the demand
of a cutting-stock problem: a pattern is a multiset of lengths that fits a sequence, and costs the size that
the sequence is padded to. The linear program over patterns starts from a greedy basis, which is triangular
since each greedy pattern uses up a length, and is improved by the revised simplex method: a knapsack solved
by dynamic programming over the room prices all patterns at once and hands back those that improve it.

The solution is rounded down, and what that leaves over is put into the fullest patterns it can make.
Documents are ranked within their length, and a rank says by arithmetic which sequence and place of which
pattern a document takes. Sequences of the patterns with the widest gaps are then taken apart into fillers:
laid end to end they are cut to the gaps of the other patterns, and the last of them into sequences of
powers of two, which need no padding.

The driver sees the histogram (a count per length) and holds the plan (patterns, at most one per length). The
rows are ranked by counts per length and hash range, so that a length may have any share of the pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, payload, slices
from lodgetier.llm.bpe import VOCABULARY, encoder, vocabulary
from lodgetier.runtime import materialise

ROOM = 1_024
END = 0

#: The program is solved when its patterns are padded by no more than this share of all tokens, and given up
#: for the rounding after so many exchanges of patterns; either way the fillers leave no padding.
PADDED = 1e-3
EXCHANGES = 4_000

#: Improving patterns taken from one knapsack.
PRICED = 40

#: Hash ranges that the pieces of a length are counted in before they are ranked.
CHUNKS = 4_096

Pattern = dict[int, int]


def padded_sizes(room: int) -> np.ndarray:
    """Size that a sequence of each length is padded to: a power of two needs no padding."""
    sizes = np.arange(room + 1)
    return np.where(sizes & (sizes - 1) == 0, sizes, room)


def knapsack(value: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, last): most value of lengths that add up to each size exactly, and a length that ends them."""
    best = np.full(room + 1, -np.inf)
    best[0] = 0.0
    last = np.zeros(room + 1, dtype=np.int64)
    turned = value[::-1]
    for size in range(1, room + 1):
        sums = best[:size] + turned[room - size : room]
        k = int(sums.argmax())
        best[size], last[size] = sums[k], size - k
    return best, last


def _traced(last: np.ndarray, size: int, first: int = 0) -> Pattern:
    found: Pattern = {first: 1} if first else {}
    while size:
        length = int(last[size])
        found[length] = found.get(length, 0) + 1
        size -= length
    return found


def _used(pattern: Pattern) -> int:
    return sum(length * times for length, times in pattern.items())


def greedy_patterns(histogram: np.ndarray, room: int) -> list[Pattern]:
    """Patterns filled with the longest lengths that fit, each applied until one of its lengths is used up."""
    left = {int(length): float(histogram[length]) for length in np.flatnonzero(histogram)}
    order, found = sorted(left), []
    while order:
        free, pattern = room, {}
        while at := bisect.bisect_right(order, free):
            length = order[at - 1]
            pattern[length] = pattern.get(length, 0) + 1
            free -= length
        times, gone = min((left[length] / n, -length) for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] = max(0.0, left[length] - n * times)
        order.remove(-gone)
        found.append(pattern)
    return found


def solve(histogram: np.ndarray, room: int, padded: float = PADDED, exchanges: int = EXCHANGES) -> tuple[list[Pattern], np.ndarray]:
    """Patterns and how often each is used, in fractions, to cover the histogram at the least padded size."""
    lengths = np.flatnonzero(histogram)
    m = len(lengths)
    if not m:
        return [], np.zeros(0)
    place = np.zeros(room + 1, dtype=np.int64)
    place[lengths] = np.arange(m)
    sizes = padded_sizes(room).astype(float)
    patterns = greedy_patterns(histogram, room)
    basis = np.zeros((m, m))
    for j, pattern in enumerate(patterns):
        basis[place[list(pattern)], j] = list(pattern.values())
    inverse = np.linalg.inv(basis)
    uses = np.maximum(inverse @ histogram[lengths].astype(float), 0.0)
    cost = np.array([sizes[_used(p)] for p in patterns])
    goal = float((histogram * np.arange(room + 1)).sum()) * (1 + padded)
    least = 1e-9 * room
    while exchanges > 0 and cost @ uses > goal:
        dual = cost @ inverse
        value = np.full(room + 1, -np.inf)
        value[lengths] = dual
        best, last = knapsack(value, room)
        gain = best - sizes
        at = int(gain[1:].argmax()) + 1
        found = [_traced(last, at)] if gain[at] > least else []
        holding = dual + best[room - lengths] - sizes[room]  # of the best full pattern that holds a length
        found += [_traced(last, room - int(lengths[i]), int(lengths[i])) for i in np.argsort(-holding)[:PRICED] if holding[i] > least]
        done = 0
        for pattern in found:
            rows, times = place[list(pattern)], np.array(list(pattern.values()), dtype=float)
            gained = times @ dual[rows] - sizes[_used(pattern)]  # the duals have moved since it was priced
            turn = inverse[:, rows] @ times
            able = turn > 1e-9
            if gained <= least or not able.any():
                continue
            ratio = np.full(m, np.inf)
            ratio[able] = uses[able] / turn[able]
            out = int(ratio.argmin())
            step = ratio[out]
            uses = np.maximum(uses - step * turn, 0.0)
            uses[out] = step
            row = inverse[out] / turn[out]
            inverse -= np.outer(turn, row)
            inverse[out] = row
            dual = dual - gained * row
            patterns[out], cost[out] = pattern, sizes[_used(pattern)]
            done += 1
        exchanges -= done
        if not done:
            break
    return patterns, uses


def fullest(left: np.ndarray, room: int) -> Pattern:
    """The fullest pattern that holds the longest length left, from what is left; longer lengths are preferred."""
    lengths = np.flatnonzero(left)
    first = int(lengths[-1])
    free = room - first
    items = [int(n) for n in lengths if n <= free for _ in range(min(int(left[n]) - (n == first), free // int(n)))]
    within = (1 << (free + 1)) - 1
    sums = [1]  # bit s: some of the items so far add up to s
    for n in items:
        sums.append((sums[-1] | sums[-1] << n) & within)
        if sums[-1] >> free & 1:
            break
    size = sums[-1].bit_length() - 1
    pattern = {first: 1}
    for at in range(len(sums) - 2, -1, -1):
        n = items[at]
        if size >= n and sums[at] >> (size - n) & 1:
            pattern[n] = pattern.get(n, 0) + 1
            size -= n
    return pattern


@dataclass(frozen=True)
class Plan:
    """Where a piece of a length and rank goes. All arrays are bounded by the number of lengths and the room.

    Slots lie in order of length and first rank: of `slot_n` pieces from rank `slot_rank` on, `slot_each` share a
    sequence, the first of them `slot_sequence`, from `slot_offset` on. Fillers of a length are the ranks from
    `filler_rank` on; they lie end to end from `filler_at` on. Gaps lie on the same line: `gap_n` gaps of `gap_size` tokens
    from `gap_at` on, one in each sequence from `gap_sequence` on, at `gap_offset`.
    """

    room: int
    slot_key: np.ndarray
    slot_rank: np.ndarray
    slot_each: np.ndarray
    slot_sequence: np.ndarray
    slot_offset: np.ndarray
    filler_rank: np.ndarray
    filler_at: np.ndarray
    gap_at: np.ndarray
    gap_size: np.ndarray
    gap_sequence: np.ndarray
    gap_offset: np.ndarray

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, begin, size, sequence, offset) of all parts of some pieces, in order of row and begin."""
        filler = rank >= self.filler_rank[length]
        whole = np.flatnonzero(~filler)
        size, at = length[whole], rank[whole]
        slot = np.searchsorted(self.slot_key, size * _RANKS + at, side="right") - 1
        inside = at - self.slot_rank[slot]
        each = self.slot_each[slot]
        sequence = self.slot_sequence[slot] + inside // each
        offset = self.slot_offset[slot] + inside % each * size
        parts = [(whole, np.zeros(len(whole), dtype=np.int64), size, sequence, offset)]
        todo = np.flatnonzero(filler)
        begin = np.zeros(len(todo), dtype=np.int64)
        while len(todo):  # a part of each filler in turn
            n = length[todo]
            place = self.filler_at[n] + (rank[todo] - self.filler_rank[n]) * n + begin
            gap = np.searchsorted(self.gap_at, place, side="right") - 1
            number, inner = np.divmod(place - self.gap_at[gap], self.gap_size[gap])
            size = np.minimum(n - begin, self.gap_size[gap] - inner)
            parts.append((todo, begin, size, self.gap_sequence[gap] + number, self.gap_offset[gap] + inner))
            begin = begin + size
            todo, begin = todo[begin < n], begin[begin < n]
        row, begin, size, sequence, offset = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((begin, row))
        return row[order], begin[order], size[order], sequence[order], offset[order]


_RANKS = 1 << 50  # more than the pieces of any length


def plan(histogram: np.ndarray, room: int = ROOM, padded: float = PADDED, exchanges: int = EXCHANGES) -> Plan:
    """The plan for counts of pieces by length, 0 to `room`."""
    histogram = histogram.astype(np.int64)
    patterns, uses = solve(histogram, room, padded, exchanges)
    times = np.floor(uses + 1e-6).astype(np.int64)
    left = histogram.copy()
    sizes = padded_sizes(room)
    for k, pattern in enumerate(patterns):  # rounding errors must not use a piece twice
        times[k] = min(times[k], *(int(left[length]) // n for length, n in pattern.items()))
        for length, n in pattern.items():
            left[length] -= n * times[k]
    extra = []
    while left.any():  # what rounding leaves, less than one sequence per pattern
        patterns.append(fullest(left, room))
        extra.append(min(int(left[length]) // n for length, n in patterns[-1].items()))
        for length, n in patterns[-1].items():
            left[length] -= n * extra[-1]
    times = np.concatenate([times, np.array(extra, dtype=np.int64)])
    waste = np.array([sizes[_used(p)] - _used(p) for p in patterns], dtype=np.int64)
    short = int((waste * times).sum()) - int((left * np.arange(room + 1)).sum())
    for k in np.argsort(-waste, kind="stable").tolist():  # a sequence taken apart closes its gap and gives the rest
        apart = min(int(times[k]), -(-short // int(sizes[_used(patterns[k])]))) if short > 0 else 0
        times[k] -= apart
        short -= apart * int(sizes[_used(patterns[k])])
        for length, n in patterns[k].items():
            left[length] += n * apart

    slots, gaps = [], []
    before = np.zeros(room + 1, dtype=np.int64)
    sequence = line = 0
    for pattern, n, wide in zip(patterns, times.tolist(), waste.tolist()):
        if not n:
            continue
        offset = 0
        for length, each in sorted(pattern.items()):
            slots.append((length, int(before[length]), each, sequence, offset))
            before[length] += each * n
            offset += each * length
        if wide:
            gaps.append((line, wide, sequence, offset))
            line += wide * n
        sequence += n
    filler_at = np.concatenate([[0], np.cumsum(left * np.arange(room + 1))[:-1]])
    rest = int((left * np.arange(room + 1)).sum()) - line
    if rest // room:
        gaps.append((line, room, sequence, 0))
        line += rest // room * room
        sequence += rest // room
    size = room
    while rest % room and size:
        if rest % room & size:
            gaps.append((line, size, sequence, 0))
            line += size
            sequence += 1
        size >>= 1
    slots.sort()
    s, g = (np.array(rows, dtype=np.int64).reshape(-1, width) for rows, width in ((slots, 5), (gaps, 4)))
    return Plan(room, s[:, 0] * _RANKS + s[:, 1], *(s[:, i] for i in range(1, 5)), before, filler_at, *(g[:, i] for i in range(4)))


_PIECE = "doc_id long, mark long, start long, length int, ids_crc32 long, doc_tokens long, tokens binary"


def pieces(docs: DataFrame, room: int = ROOM, end: int = END, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, mark, start, length, ids_crc32, doc_tokens, tokens) of the pieces of every whole text with `end` behind it.

    `tokens` are little-endian unsigned integers of two bytes, or four if the vocabulary needs them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(path).encode, token_type(path)
        for batch in batches:
            texts = payload(batch.column("text"))
            for i, j in slices(texts):
                rows = []
                for at, ids in zip(range(i, j), encode(texts[i:j])):
                    ids = np.append(ids, end).astype("<u4")
                    for start in range(0, len(ids), room):
                        some = ids[start : start + room]
                        rows.append((at, start, len(some), zlib.crc32(some.tobytes()), len(ids), some.astype(kind).tobytes()))
                owner, *columns = zip(*rows)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array(owner)) for c in ("doc_id", "mark")] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    [c.split()[0] for c in _PIECE.split(", ")],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"), run, _PIECE)


def token_type(path: str) -> str:
    return "<u2" if vocabulary(path).size <= 1 << 16 else "<u4"


def ranked(cut: DataFrame) -> DataFrame:
    """Pieces with `rank` from 0 within their length, in the order of a hash; equal rows are interchangeable."""
    dealt = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "mark", "start"), F.lit(CHUNKS)).cast("int"))
    counts = dealt.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "chunk").orderBy("doc_id", "mark", "start", "ids_crc32")
    numbered = dealt.withColumn("inner", F.row_number().over(inner) - 1)
    return numbered.join(offsets.hint("merge"), ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("inner")).drop("chunk", "before", "inner")


_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_pieces(docs: DataFrame, room: int = ROOM, end: int = END, path: str = VOCABULARY, with_tokens: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece in its sequence.

    Each id of a text, and the end id, lies in exactly one piece; null and empty texts are the end id alone.
    Copies and repeated rows are packed each; a null doc_id is passed on. Sequences are numbered from 0 and
    hold `room` ids or a power of two. Columns but doc_id and text are not read. An empty table gives an empty
    one. `with_tokens` adds the piece's tokens.
    """
    cut = materialise(pieces(docs, room, end, path), "pieces")
    histogram = np.zeros(room + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():  # `room` rows at most
        histogram[row["length"]] = row["count"]
    made = plan(histogram, room)
    kind = token_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row, begin, size, sequence, offset = made.places(length, rank)
            owner = pa.array(row)
            crc = batch.column("ids_crc32").to_numpy()[row].copy()
            part = size < length[row]
            held = batch.column("tokens")
            cut_tokens = []
            for i in np.flatnonzero(part).tolist():
                some = np.frombuffer(held[int(row[i])].as_py(), kind)[begin[i] : begin[i] + size[i]]
                crc[i] = zlib.crc32(some.astype("<u4").tobytes())
                cut_tokens.append(some.tobytes())
            tokens = pc.replace_with_mask(held.take(owner), pa.array(part), pa.array(cut_tokens, pa.binary())) if with_tokens else None
            columns = [
                batch.column("doc_id").take(owner), pa.array(batch.column("start").to_numpy()[row] + begin), pa.array(size),
                pa.array(crc), batch.column("doc_tokens").take(owner), pa.array(sequence), pa.array(offset),
            ]
            names = [c.split()[0] for c in _PLACED.split(", ")]
            yield pa.RecordBatch.from_arrays(columns + [tokens] * with_tokens, names + ["tokens"] * with_tokens)

    return map_batches(ranked(cut), run, _PLACED + ", tokens binary" * with_tokens)


def sequences(docs: DataFrame, room: int = ROOM, end: int = END, path: str = VOCABULARY) -> DataFrame:
    """(sequence_id, tokens, doc_ids, offsets): every sequence whole, with the documents in it and where they begin."""
    placed = packed_pieces(docs, room, end, path, with_tokens=True)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "tokens")))  # `room` parts at most
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["tokens"])).alias("tokens"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"),
    )
