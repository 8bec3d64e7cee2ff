"""Near-duplicates by SimHash fingerprints, found with anchor points of a covering code.

Fingerprints at `MOST_BITS` or fewer differing bits are linked. Of 64 bits, one half then differs in at
most one bit. In the low 31 bits of each half the codewords of the perfect Hamming code (31, 26) serve as
anchors: every point has exactly one codeword within the covering radius of 1. A fingerprint is sent to all
anchors within radius plus threshold (1 + 1), that is to its home and 15 others. Two fingerprints at most
one bit apart in a half meet at the home anchor of either, so no link is lost, and each meeting is checked
on all 64 bits. Equal fingerprints are merged before, and only links that join two so far separate groups
leave an anchor. Anchors with many members are cut into tiles; every pair of tiles is compared by a task of
its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, payload, set_aside, whole_groups
from lodgetier.llm.components import components
from lodgetier.runtime import materialise

SHINGLE = 3
MOST_BITS = 3

#: Members of an anchor compared in one group; more are cut into tiles of about this size.
TILE = 2_048

#: Shingles counted at a time.
CHUNK = 1 << 16

# The check masks of the Hamming code of length 31 (bit i takes part in check k if bit k of i + 1 is set).
CHECKS = [sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    if len(words) <= shingle:
        grams = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(42))
    for start in range(0, n, CHUNK):
        some = np.fromiter(hashes, dtype="<u8", count=min(CHUNK, n - start))
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *longs: str) -> DataFrame:
    """(doc_id, fp) and columns `longs` for every row; fp is the fingerprint as a signed long. A null text has no
    words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in payload(batch.column("text"))], dtype=np.uint64)
            kept = [batch.column(c) for c in longs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *kept], ["doc_id", "fp", *longs])

    schema = "doc_id long, fp long" + "".join(f", {c} long" for c in longs)
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", *longs), run, schema)


def anchored(points: DataFrame) -> DataFrame:
    """Each fingerprint at all its anchors: (anchor, home, fp, node)."""
    halves = F.array(*(
        F.struct(F.lit(k).cast("long").alias("k"), F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit((1 << 31) - 1)).alias("h"))
        for k in (0, 1)
    ))
    syndrome = " + ".join(f"(bit_count(h & {mask}L) % 2) * {1 << k}" for k, mask in enumerate(CHECKS))
    others = (
        "transform(filter(sequence(1, 31), i -> i < (i ^ s)),"
        " i -> struct(h ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1) as c, false as home))"
    )
    home = "array(struct(if(s = 0, h, h ^ shiftleft(1L, s - 1)) as c, true as home))"
    return (
        points.withColumn("half", F.explode(halves))
        .select("fp", "node", "half.k", "half.h")
        .withColumn("s", F.expr(f"cast({syndrome} as int)"))
        .withColumn("at", F.explode(F.expr(f"concat({home}, {others})")))
        .select(F.expr("shiftleft(k, 32) | at.c").alias("anchor"), "at.home", "fp", "node")
    )


def local_links(anchor: np.ndarray, fp: np.ndarray, node: np.ndarray, most_bits: int) -> tuple[list, list]:
    """Links that join groups, among rows sorted by group; one row's successors are compared step by step."""
    n = len(fp)
    parent = np.arange(n)
    a_side, b_side = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    change = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True)) + 1
    end = np.repeat(change, np.diff(np.concatenate([[0], change])))
    active, step = np.arange(n), 1
    while True:
        active = active[active + step < end[active]]
        if not len(active):
            return a_side, b_side
        near = active[np.bitwise_count(fp[active] ^ fp[active + step]) <= most_bits]
        if len(near):
            flat = parent
            while not np.array_equal(flat, up := flat[flat]):
                flat = up
            parent = flat.copy()
            for i in near[flat[near] != flat[near + step]].tolist():
                x, y = root(i), root(i + step)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    a_side.append(int(node[i]))
                    b_side.append(int(node[i + step]))
        step += 1


def linked(points: DataFrame, most_bits: int = MOST_BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) of nodes that connect all fingerprints within `most_bits` (3 at most), through anchors."""
    if most_bits > 3:
        raise ValueError("halves of radius one hold for 3 differing bits at most")
    at = anchored(points)
    crowd = at.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("homes")).where("n > 1 and homes")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    met = (
        at.join(crowd.select("anchor", tiles.alias("tiles")).hint("merge"), "anchor")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
        .select(
            F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), "fp", "node"
        )
        .repartition("meeting")
        .sortWithinPartitions("meeting", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "meeting"):
            meeting, fp, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("meeting", "fp", "node"))
            a, b = local_links(meeting, fp.astype(np.uint64), node, most_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return map_batches(met, run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, *longs: str) -> DataFrame:
    """(doc_id, fp, component_id) and columns `longs` for every row of `docs` (doc_id, text).

    Null and empty texts have fingerprint 0 and link like any other; texts with fewer words than a shingle
    are one shingle. Copies share their fingerprint and thus their component. Rows with the same doc_id are
    each returned; different texts of one doc_id are linked only if their fingerprints are. A row without
    doc_id links like any other; component_id is null where no row of a component has one. Other columns of
    `docs` are not read. An empty table gives an empty one.
    """
    found = materialise(fingerprints(docs, shingle, *longs), "fingerprints")
    return found.join(component_ids(found, most_bits), "fp", "left").select("doc_id", "fp", "component_id", *longs)


def component_ids(found: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(fp, component, component_id): the component of each fingerprint, named by its least fingerprint, and by
    its least doc_id, null if none of its rows has one."""
    points = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "points")
    roots = components(linked(points, most_bits))
    own = points.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("component"))
    own = materialise(own, "components")
    named = own.groupBy("component").agg(F.min("least").alias("component_id"))
    return own.join(named, "component").select("fp", "component", "component_id")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint in hexadecimal, component_id."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """Of each component of `docs` one row: that of its smallest doc_id (null last), of several the one with the
    least fingerprint, text hash and then other columns.

    Rows are told apart by doc_id and a hash of the text. Other columns may have any name and type.
    """
    plain, named = set_aside(docs, "doc_id", "text")
    keyed = plain.withColumn("_mark", F.xxhash64("text"))
    found = materialise(fingerprints(keyed, shingle, "_mark"), "fingerprints")
    placed = found.join(component_ids(found, most_bits), "fp")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp", "_mark")
    chosen = placed.groupBy("component").agg(F.min(key).alias("row"))
    chosen = materialise(chosen.select(F.col("row.doc_id").alias("_id"), F.col("row._mark").alias("_chosen")), "chosen")
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_chosen"))
    rows = keyed.join(chosen.hint("merge"), same, "left_semi")
    rest = [c for c in plain.columns if c != "doc_id"]
    order = F.struct(*(F.to_json(F.struct(c)) if "map<" in plain.schema[c].dataType.simpleString() else F.col(c) for c in rest))
    one = rows.groupBy("doc_id", "_mark").agg(F.min_by(F.struct(*rest), order).alias("row"))
    return named(one.select("doc_id", "row.*"))
