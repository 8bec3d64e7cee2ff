"""Token ids in files of Simple-8b words.

A file row is a block of whole documents: their ids end to end, packed into 64-bit words. The four high bits
of a word are its selector, which says how many ids of how many bits its low 60 bits hold; the first id is in
the lowest bits. Selector 14 stands for a run of zeros whose length is in the low bits. An id of more than 60
bits escapes: selector 15, with its number in the block's escape list in the low bits. Each block has the
place of every document among its ids, so a document can be read alone, and a block is decoded by one pass
per selector. The container is Parquet (column `words`, little-endian), one file per task, so files can be
in any store and only finished tasks leave any.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodgetier.llm.base import map_batches, payload, spread
from lodgetier.llm.chunks import ChunkStore
from lodgetier.runtime import scratch_path

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 2

#: Ids of a block: documents are added until it holds as many.
BLOCK_IDS = 1 << 16

#: Texts given to the tokenizer in a call, and words in such a text.
LEARN_TEXTS = 4_096
JOINED = 100

# Ids per word and bits per id of selectors 0 to 13.
PER_WORD = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ZEROS, ESCAPE = 14, 15
LEAST_ZEROS = 61


_SHORT = np.searchsorted((1 << BITS[:12]) - 1, np.arange(1 << 16)).astype(np.int8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """The least bits of a selector that hold each id; 61 for ids that none holds."""
    if ids.max() < 1 << 16:
        return BITS.astype(np.int8)[_SHORT[ids.astype(np.int64)]]
    out = np.zeros(len(ids), dtype=np.int8)
    for bits in BITS.tolist()[::-1]:
        out[ids < np.uint64(1 << bits)] = bits
    out[ids >= np.uint64(1 << 60)] = 61
    return out


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit ids: at each place the selector that takes the most ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    need = np.concatenate([_bit_lengths(ids), np.ones(60, dtype=np.int8)])  # beyond the end: zeros
    take = np.ones(n, dtype=np.int64)
    chosen = np.full(n, 13, dtype=np.int8)
    widest, done = need, 1  # widest[i]: most bits among `done` ids from i on
    for selector in range(12, -1, -1):
        count = int(PER_WORD[selector])
        while done < count:
            step = min(done, count - done)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            done += step
        fits = widest[:n] <= BITS[selector]
        if not fits.any():
            break  # fewer bits for more ids can't fit either
        take[fits], chosen[fits] = count, selector
    chosen[need[:n] == 61] = ESCAPE
    zero = ids == 0
    if zero.any():  # runs of zeros longer than a word of single bits holds
        stop = np.minimum.accumulate(np.where(zero, n, np.arange(n))[::-1])[::-1]
        run = np.where(zero, stop - np.arange(n), 0)
        long = run >= LEAST_ZEROS
        take[long], chosen[long] = run[long], ZEROS
    jump, at, starts = (np.arange(n) + take).tolist(), 0, []
    while at < n:
        starts.append(at)
        at = jump[at]
    starts = np.array(starts)
    chosen, take = chosen[starts].astype(np.int64), take[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, dtype=np.uint64)])
    for selector in np.unique(chosen[chosen < ZEROS]).tolist():
        here = np.flatnonzero(chosen == selector)
        place, bits = starts[here], int(BITS[selector])
        for k in range(int(PER_WORD[selector])):
            words[here] |= padded[place + k] << np.uint64(k * bits)
    words[chosen == ZEROS] |= take[chosen == ZEROS].astype(np.uint64)
    escaped = chosen == ESCAPE
    words[escaped] |= np.arange(int(escaped.sum()), dtype=np.uint64)
    return words, ids[starts[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of packed words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    body = words & np.uint64((1 << 60) - 1)
    count = np.append(PER_WORD, [0, 1])[selector]
    count[selector == ZEROS] = body[selector == ZEROS].astype(np.int64)
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    starts = ends - count
    for s in np.unique(selector).tolist():
        here = np.flatnonzero(selector == s)
        if s < ZEROS:
            bits = int(BITS[s])
            mask = np.uint64((1 << bits) - 1)
            for k in range(int(PER_WORD[s])):
                out[starts[here] + k] = (body[here] >> np.uint64(k * bits)) & mask
        elif s == ESCAPE:
            out[starts[here]] = escapes[body[here].astype(np.int64)]
    return out[:n]


class WordEncoder:
    """Ids by a tokenizer that drops white space, one call of the library per chunk not met before."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.marks = {s[:2] for s in special}
        self.encode = ChunkStore(self.learn, self.plain, self.whole, every_space=True, lower=True).encode

    def plain(self, text: bytes) -> bool:
        """Whether no special token can be in a text; those are told by case, chunks are not."""
        return not any(m in text for m in self.marks)

    def _several(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(texts), LEARN_TEXTS):
            some = self.tokenizer.encode_batch_fast(texts[i : i + LEARN_TEXTS], add_special_tokens=False)
            out += [e.ids for e in some]
        return out

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of ASCII letters are given to the library many at a time; their ids end with a word's end."""
        bare = [c.strip() for c in chunks]
        simple = np.array([c.isalpha() for c in bare])
        at = np.flatnonzero(simple)
        joined = [b" ".join([bare[i] for i in at[k : k + JOINED]]).decode() for k in range(0, len(at), JOINED)]
        ids = np.array([x for some in self._several(joined) for x in some], dtype=np.int64)
        ends = np.flatnonzero(self.last[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        if len(ends) != len(at):  # a vocabulary without word ends
            at, ids, ends, simple = at[:0], ids[:0], ends[:0], np.zeros(len(chunks), dtype=bool)
        rest = np.flatnonzero(~simple)
        others = self._several([chunks[i].decode() for i in rest])
        lengths = np.zeros(len(chunks), dtype=np.int64)
        lengths[at] = np.diff(np.append(-1, ends))
        lengths[rest] = [len(x) for x in others]
        flat = np.concatenate([ids, np.array([x for some in others for x in some], dtype=np.int64)])
        owner = np.concatenate([at, rest])
        starts = np.zeros(len(chunks), dtype=np.int64)
        starts[owner] = np.cumsum(lengths[owner]) - lengths[owner]
        return flat[spread(lengths, starts)], lengths

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype=np.int64)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_BLOCK = "part int, block int, start long, n_ids long, doc_ids array<long>, offsets array<long>, words binary, escapes binary"


def write_ids(docs: DataFrame, out: str, path: str = VOCABULARY, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text, adds `end`, and writes the ids under `out` in ascending doc_id order.

    Files follow each other in the order of their part; start counts a part's ids before a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path).encode
        part = TaskContext.get().partitionId()
        block, start, names, held, count = 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            offsets = np.cumsum([0, *(len(h) for h in held)])
            words, escapes = pack(ids)
            row = [part, block, start, len(ids), names, offsets.tolist(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns = [pa.array([v], k) for v, k in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            texts, ids = payload(batch.column("text")), batch.column("doc_id").to_pylist()
            for name, some in zip(ids, encode(texts)):
                names.append(name)
                held.append(np.append(some, end).astype(np.uint64))
                count += len(some) + 1
                if count >= block_ids:
                    yield closed()
                    block, start, names, held, count = block + 1, start + count, [], [], 0
        if held:
            yield closed()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")
    map_batches(ordered, run, _BLOCK).write.option("compression", "zstd").parquet(out)


def read_ids(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in files by `write_ids`; `with_ids` adds ids.

    start counts the ids of all documents before it, over all files.
    """
    blocks = spark.read.schema(_BLOCK).parquet(out)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per file
    before, base = 0, {}
    for row in parts:
        base[row["part"]] = before
        before += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"), row["n_ids"])
                offsets = np.array(row["offsets"], dtype=np.int64)
                wide = ids.astype("<u4")
                cut = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(base[row["part"]] + row["start"] + offsets[:-1]),
                    pa.array(np.diff(offsets)), pa.array([zlib.crc32(wide[i:j].tobytes()) for i, j in cut], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[i:j].astype(np.int64) for i, j in cut], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_batches(blocks, run, schema)


def ids_table(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone. Null doc_ids come first; rows with one doc_id are ordered by
    text. Special tokens written in a text become their id. Columns but doc_id and text are not read. An empty
    table gives an empty one. The files stay in the scratch folder.
    """
    out = scratch_path(docs.sparkSession, "token-ids")
    write_ids(docs, out, path)
    return read_ids(docs.sparkSession, out)
