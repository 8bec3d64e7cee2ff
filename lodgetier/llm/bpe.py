"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task cuts its texts into chunks and each chunk it has not met before into words by the tokenizer's pattern. The new words of a slice lie end to end as one array of symbols. An index maps each
adjacent pair that has a merge rank to all its positions. Ranks are then applied in ascending order, lowest
active one first: all positions of a pair are merged at once, and the pairs to the left and right of each are
entered in the index. Texts are put together from the chunks' ids. Decoding looks up each id's bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, payload, slices, spread
from lodgetier.llm.chunks import ChunkStore

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Chunks whose ids a task process keeps.
KEPT_CHUNKS = 200_000

# Where a run of white space goes on across a space that would start a chunk; white space beyond ASCII.
_RUN_ON = regex.compile(rb"[\x09-\x0D\x1C-\x20] (?:[\x09-\x0D\x1C-\x20]|\Z)")
_WIDE_SPACE = regex.compile(rb"\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Vocabulary:
    """Merges, ids and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        ids, merges = data["model"]["vocab"], data["model"]["merges"]
        letters = _byte_letters()
        to_bytes = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        to_bytes |= {i: text.encode() for text, i in self.special.items()}
        self.size = max(to_bytes) + 1
        self.byte_id = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = ids[letter]
        split = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([ids[a] for a, _ in split], dtype=np.int64)
        right = np.array([ids[b] for _, b in split], dtype=np.int64)
        self.left, self.right = left, right
        self.merged = np.array([ids[a + b] for a, b in split], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        lengths = np.zeros(self.size, dtype=np.int64)
        for i, b in to_bytes.items():
            lengths[i] = len(b)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(to_bytes.get(i, b"") for i in range(self.size)), dtype=np.uint8)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 for none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """Positions of every mergeable pair by rank, and the ranks still to apply."""

    def __init__(self, ranks: np.ndarray, positions: np.ndarray):
        self.at: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.add(ranks, positions)

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks >= 0
        if not known.any():
            return
        ranks, positions = ranks[known], positions[known]
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            if rank in self.at:
                self.at[rank].append(some)
            else:
                self.at[rank] = [some]
                heapq.heappush(self.heap, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.heap)
        at = np.sort(np.concatenate(self.at.pop(rank)))
        return rank, at[np.append(True, at[1:] != at[:-1])]


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the number of ids of each."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    if not lengths.sum():
        return np.zeros(0, dtype=np.int64), lengths
    symbol = v.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(symbol)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    ends = np.cumsum(lengths)[lengths > 0]
    after[ends - 1] = -1
    before[ends[:-1]] = -1
    alive = np.ones(n, dtype=bool)
    pairs = np.flatnonzero(after >= 0)
    index = PairIndex(v.ranks_of(symbol[pairs], symbol[pairs + 1]), pairs)
    while index.heap:
        rank, at = index.pop()
        a, b = v.left[rank], v.right[rank]
        at = at[alive[at] & (symbol[at] == a)]
        nxt = after[at]
        ok = nxt >= 0
        at, nxt = at[ok], nxt[ok]
        ok = symbol[nxt] == b
        at, nxt = at[ok], nxt[ok]
        if not len(at):
            continue
        if a == b and len(at) > 1:  # in a run of equal symbols every other pair is merged, from the left
            fresh = np.append(True, nxt[:-1] != at[1:])
            number = np.arange(len(at))
            odd = (number - np.maximum.accumulate(np.where(fresh, number, 0))) & 1
            at, nxt = at[odd == 0], nxt[odd == 0]
        symbol[at] = v.merged[rank]
        alive[nxt] = False
        beyond = after[nxt]
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        prior = before[at]
        led = prior >= 0
        fresh = np.concatenate([at[has], prior[led]])
        index.add(v.ranks_of(symbol[fresh], symbol[np.concatenate([beyond[has], at[led]])]), fresh)
    word = np.repeat(np.arange(len(words)), lengths)[alive]
    return symbol[alive], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes texts by a byte-level vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.tokens = [t.encode() for t in v.special]
        self.store = ChunkStore(self.learn, self.plain, self.whole, kept=KEPT_CHUNKS)
        self.encode = self.store.encode

    def plain(self, text: bytes) -> bool:
        return not (any(t in text for t in self.tokens) or _RUN_ON.search(text) or text.isspace() or not text.isascii() and _WIDE_SPACE.search(text))

    def words(self, chunk: bytes) -> list[bytes]:
        body = chunk[1:] if chunk[:1] == b" " else chunk
        if body.isalpha():  # bytes: ASCII letters only
            return [chunk]
        text = chunk.decode()
        if (text[1:] if text[0] == " " else text).isalpha():
            return [chunk]
        return [w.encode() for w in self.v.pattern.findall(text)]

    def learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks end to end, and the number of ids of each."""
        cut = [self.words(c) for c in chunks]
        place: dict[bytes, int] = {}
        which = np.array([place.setdefault(w, len(place)) for words in cut for w in words], dtype=np.int64)
        ids, lengths = encode_words(list(place), self.v)
        starts = np.cumsum(lengths) - lengths
        per_word = lengths[which]
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in cut])
        per_chunk = np.bincount(owner, weights=per_word, minlength=len(chunks)).astype(np.int64)
        return ids[spread(per_word, starts[which])], per_chunk

    def whole(self, text: bytes) -> np.ndarray:
        """Ids of a text with special tokens or runs of white space, cut by the pattern alone."""
        found = []
        for part in self.v.cut.split(text.decode()) if self.v.cut else [text.decode()]:
            if part in self.v.special:
                found.append(np.array([self.v.special[part]]))
            else:
                found.append(encode_words([w.encode() for w in self.v.pattern.findall(part)], self.v)[0])
        return np.concatenate(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The task process's encoder; kept from task to task."""
    return Encoder(vocabulary(path))


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    return v.flat[spread(v.lengths[ids], v.starts[ids])].tobytes().decode("utf-8", "replace")


def bpe_table(docs: DataFrame, path: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per document: n_tokens, SHA-256 of its ids and of the decoded text; `with_ids` adds the ids.

    Null and empty texts have no ids. Special tokens written in a text become their id. Repeated rows give a
    row each; the doc_id is passed on, null included. Other columns are not read. An empty table gives an
    empty one. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, e = vocabulary(path), encoder(path)
        for batch in batches:
            texts = payload(batch.column("text"))
            for i, j in slices(texts):
                count, of_ids, of_text, kept = [], [], [], []
                for ids in e.encode(texts[i:j]):
                    count.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(decode(ids, v).encode()).hexdigest())
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                columns = [
                    batch.column("doc_id").slice(i, j - i), pa.array(count, pa.int64()),
                    pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *count]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.concatenate(kept) if kept else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema + ", ids array<int>" * with_ids)


def decode_table(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else decode(np.array(ids, dtype=np.int64), v) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
