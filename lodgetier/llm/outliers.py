"""Quality rules with robust multivariate outliers.

Each document has a vector of transformed statistics. For every language and source, for every language and
for all documents, centre and scatter are the minimum covariance determinant estimate: of half of the rows,
those whose covariance has the smallest determinant. Four starts around the medians (median deviations alone,
and with correlations of values, of their hyperbolic tangents and of their directions) take concentration
steps, each to mean and covariance of the half that is nearest under the last; after two steps the two best
go on until their determinant falls no more, and the better one is kept. A document is rejected beyond a
quantile of the squared Mahalanobis distance.

Vectors are packed in blocks of about `BLOCK` rows of one group, so a group may hold any share of the rows.
A step is two passes over the blocks: counts per distance bin and start, which give the bin that half of the
rows end in, and sums of products below it. Rows of that last bin, and so equal vectors, count by the share
that is still needed. Only groups' counts and sums are moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, payload
from lodgetier.runtime import materialise, small_or_spread_join

WINDOW = 8
SHORT = 20
REPEATED_PERCENT = 30

#: Share of rows that the scatter is taken from, steps at most, and rows a group needs for its own estimate.
SHARE = 0.5
STEPS = 30
LEAST_ROWS = 100

#: Steps after which only the best starts go on, and how many do.
FIRST_STEPS = 2
STARTS_KEPT = 2

#: A start rests when the logarithm of its determinant falls by less.
RESTING = 1e-6

#: Rows further out than all but this share of normal rows are rejected.
BEYOND = 1e-4

#: Words by which rates of short texts are drawn towards zero.
SHRINK = 40

#: Distances and values are told apart to 1/GRAIN (distances on a log scale).
GRAIN = 128

#: Rows of a block, and groups whose estimates may be broadcast (a few hundred bytes each).
BLOCK = 2_048
FEW_GROUPS = 20_000

#: The vector: column expression and the least deviation that counts as one.
VECTOR: list[tuple[str, float]] = [
    ("ln(1 + n_words)", 0.5),
    (f"ln((word_chars + 6 * {SHRINK}) / (n_words + {SHRINK}))", 0.03),
    (f"sqrt(n_symbols / (word_chars + 6 * {SHRINK}))", 0.02),
    (f"sqrt(n_dup_lines / (n_words + {SHRINK}))", 0.03),
    (f"sqrt(n_repeat_words / (n_words + {SHRINK}))", 0.08),
    (f"sqrt(n_upper / (word_chars + 6 * {SHRINK}))", 0.03),
]
P = len(VECTOR)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    names: dict[bytes, int] = {}
    code = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    length = 1  # code[i] names the run of `length` words from i; runs are joined to longer ones
    while length < window:
        step = min(length, window - length)
        pair = code[: len(code) - step] * (int(code.max()) + 1) + code[step:]
        distinct, code, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(distinct) == len(pair):
            return 0
        length += step
    start = np.flatnonzero(counts[code] > 1)
    turn = np.zeros(n + 1, dtype=np.int64)
    turn[start] += 1
    turn[start + window] -= 1
    return int((np.cumsum(turn) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper of a whole text."""
    words = text.split()
    points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))  # continuation bytes
    bare = len(text.translate(None, b"\t\n\v\f\r "))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else []
    return len(words), bare - points, symbols, len(lines) - len(set(lines)), repeated_words(words), upper


_STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) and the statistics of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics(t) for t in payload(batch.column("text"))], dtype=np.int64).reshape(-1, 6)
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(found[:, i]) for i in range(6))], ["doc_id", "lang", "source", *_STATISTICS]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _STATISTICS)
    return map_batches(narrow, run, schema)


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_above(mid, degrees) > 1 - p else (low, mid)
    return high


def _chi_square_above(x: float, degrees: int) -> float:
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def _groups() -> list[Column]:
    """Names of the three groups of a row, narrowest first; a null is a value of its own."""
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in (F.col("lang"), F.col("source")))
    narrow = F.concat(F.length(lang).cast("string"), F.lit(":"), lang, source)
    return [F.concat(F.lit("3"), narrow), F.concat(F.lit("2"), lang), F.lit("1")]


def _edges(counts: DataFrame, keys: list[str], share: float, more: int = 0) -> DataFrame:
    """(keys, edge, below, at, need): from counts `n` per integer `bin`, the bin in which the first `need` rows of
    a key end, the rows before it and in it; `need` is the share of all rows, of `more` rows more if there are."""
    so_far = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)  # over the bins of a key
    need = F.least(F.ceil((F.sum("n").over(whole) + more) * share), F.sum("n").over(whole))
    running = counts.withColumns({"upto": F.sum("n").over(so_far), "need": need.cast("long")})
    return running.where("upto >= need and upto - n < need").select(
        *keys, F.col("bin").alias("edge"), (F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("at"), "need"
    )


def _with_estimates(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """Blocks with the row that `table` has for their group."""
    if table.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        return blocks.join(F.broadcast(table), "grp")
    copies = blocks.select("grp", "salt").join(table, "grp")  # narrow rows; blocks meet their copy by both keys
    return blocks.join(copies, ["grp", "salt"])


def vector_blocks(stats: DataFrame, least_rows: int = LEAST_ROWS, block: int = BLOCK) -> DataFrame:
    """(grp, salt, x): vectors of rows that pass the base rules, packed by group; groups of fewer rows are left out."""
    vectors = stats.where("not base_failed").select(
        F.explode(F.array(*_groups())).alias("grp"), F.array(*(F.expr(e).cast("double") for e, _ in VECTOR)).alias("x"),
        F.xxhash64(*stats.columns, F.monotonically_increasing_id()).alias("mark"),
    )
    sizes = vectors.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows)
    sizes = materialise(sizes.select("grp", F.ceil(F.col("n") / block).alias("blocks")), "group-sizes")
    salted = small_or_spread_join(vectors, sizes, ["grp"], "inner").withColumn("salt", F.pmod("mark", F.col("blocks")))

    def pack(part: pa.Table) -> pa.Table:
        x = part.column("x").combine_chunks().flatten().to_numpy().tobytes()
        return pa.table({"grp": part.column("grp")[:1], "salt": part.column("salt")[:1], "x": pa.array([x], pa.binary())})

    packed = salted.select("grp", "salt", "x").groupBy("grp", "salt").applyInArrow(pack, "grp string, salt long, x binary")
    return materialise(packed, "vectors")


def _matrix(data) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.float64).reshape(-1, P)


def _rows_of(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _medians(blocks: DataFrame) -> DataFrame:
    """(grp, centre, sd): medians and median deviations, exact to 1 / GRAIN."""

    def counts(met: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                centres = batch.column("centre").to_pylist() if "centre" in batch.schema.names else None
                for i, (grp, data) in enumerate(zip(batch.column("grp").to_pylist(), batch.column("x"))):
                    bins = np.floor(_matrix(data) * GRAIN).astype(np.int64)
                    if centres:
                        bins = np.abs(bins - np.array(centres[i]))
                    for dim in range(P):
                        out += [(grp, dim, b, n) for b, n in zip(*(a.tolist() for a in np.unique(bins[:, dim], return_counts=True)))]
                yield _rows_of(["grp", "dim", "bin", "n"], out, [pa.string(), pa.int32(), pa.int64(), pa.int64()])

        parts = map_batches(met, run, "grp string, dim int, bin long, n long")
        return parts.groupBy("grp", "dim", "bin").agg(F.sum("n").alias("n"))

    def listed(edges: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("dim", "edge")))  # one per dimension
        return edges.groupBy("grp").agg(F.transform(ordered, lambda e: e["edge"]).alias(name))

    centre = materialise(listed(_edges(counts(blocks.select("grp", "x")), ["grp", "dim"], 0.5), "centre"), "medians")
    away = counts(_with_estimates(blocks, centre).select("grp", "x", "centre"))
    sd = listed(_edges(away, ["grp", "dim"], 0.5), "sd")
    least = F.array(*(F.lit(x) for _, x in VECTOR))
    return materialise(
        centre.join(sd, "grp").select(
            "grp", F.transform("centre", lambda c: (c + 0.5) / F.lit(GRAIN)).alias("centre"),
            F.zip_with(F.transform("sd", lambda d: d * F.lit(1.4826 / GRAIN)), least, lambda d, low: F.greatest(d, low)).alias("sd"),
        ), "medians",
    )


def _correlation(products: np.ndarray) -> np.ndarray:
    spread = np.sqrt(np.maximum(np.diag(products), 1e-12))
    return products / np.outer(spread, spread)


def whitened(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """A matrix that turns a scatter into the identity, and the logarithm of its determinant; directions that
    vary less than the least deviations have these instead."""
    least = np.array([low for _, low in VECTOR])
    values, vectors = np.linalg.eigh(cov / np.outer(least, least))
    values = np.maximum(values, 1.0)
    return (vectors / np.sqrt(values)).T / least, float(np.log(values).sum())


_ESTIMATE = "grp string, start int, centre array<double>, white array<double>, logdet double, rested boolean"
_ESTIMATE_KINDS = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.bool_()]
_ESTIMATE_NAMES = ["grp", "start", "centre", "white", "logdet", "rested"]


def _starts(blocks: DataFrame) -> DataFrame:
    """The four starting estimates of each group."""
    medians = _medians(blocks)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("grp", "centre", "sd"))
            for grp, centre, sd, data in zip(*columns, batch.column("x")):
                z = (_matrix(data) - centre) / sd
                way = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                for start, v in enumerate((z, np.tanh(z), way)):
                    out += [(grp, start + 1, i, float(x)) for i, x in enumerate((v.T @ v).ravel())]
            yield _rows_of(["grp", "start", "i", "v"], out, [pa.string(), pa.int32(), pa.int32(), pa.float64()])

    met = _with_estimates(blocks, medians).select("grp", "x", "centre", "sd")
    sums = map_batches(met, products, "grp string, start int, i int, v double").groupBy("grp", "start", "i").agg(F.sum("v").alias("v"))
    lists = sums.groupBy("grp", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("products"))
    plain = medians.select("grp", F.lit(0).alias("start"), F.lit(None).cast("array<double>").alias("products"))
    every = plain.unionByName(lists).join(medians, "grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                corr = np.eye(P) if row["products"] is None else _correlation(np.array(row["products"]).reshape(P, P))
                white, _ = whitened(corr * np.outer(row["sd"], row["sd"]))
                out.append((row["grp"], row["start"], row["centre"], white.ravel().tolist(), math.inf, False))
            yield _rows_of(_ESTIMATE_NAMES, out, _ESTIMATE_KINDS)

    return map_batches(every, run, _ESTIMATE)


def _bins(x: np.ndarray, centre: list[float], white: list[float]) -> np.ndarray:
    away = (x - np.array(centre)) @ np.array(white).reshape(P, P).T
    return np.floor(np.log((away**2).sum(axis=1) + 1e-9) * GRAIN).astype(np.int64)


def _step(blocks: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """Estimates after a concentration step."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, data, starts in zip(batch.column("grp").to_pylist(), batch.column("x"), batch.column("starts").to_pylist()):
                for e in starts:
                    found = np.unique(_bins(_matrix(data), e["centre"], e["white"]), return_counts=True)
                    out += [(grp, e["start"], b, n) for b, n in zip(*(a.tolist() for a in found))]
            yield _rows_of(["grp", "start", "bin", "n"], out, [pa.string(), pa.int32(), pa.int64(), pa.int64()])

    def by_group(table: DataFrame, *fields: str) -> DataFrame:
        return table.groupBy("grp").agg(F.collect_list(F.struct("start", *fields)).alias("starts"))  # four at most

    met = _with_estimates(blocks, by_group(estimate, "centre", "white"))
    counts = map_batches(met.select("grp", "x", "starts"), counted, "grp string, start int, bin long, n long")
    edges = _edges(counts.groupBy("grp", "start", "bin").agg(F.sum("n").alias("n")), ["grp", "start"], share, P + 1)
    known = materialise(estimate.join(edges, ["grp", "start"]), "edges")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for grp, data, starts in zip(batch.column("grp").to_pylist(), batch.column("x"), batch.column("starts").to_pylist()):
                x = _matrix(data)
                for e in starts:
                    bins = _bins(x, e["centre"], e["white"])
                    weight = np.where(bins < e["edge"], 1.0, np.where(bins == e["edge"], (e["need"] - e["below"]) / e["at"], 0.0))
                    inside = x - np.array(e["centre"])  # sums around the last centre keep their digits
                    sums = [weight.sum(), *(weight @ inside), *((inside * weight[:, None]).T @ inside).ravel()]
                    out += [(grp, e["start"], i, float(v)) for i, v in enumerate(sums)]
            yield _rows_of(["grp", "start", "i", "v"], out, [pa.string(), pa.int32(), pa.int32(), pa.float64()])

    met = _with_estimates(blocks, by_group(known, "centre", "white", "edge", "below", "at", "need"))
    sums = map_batches(met.select("grp", "x", "starts"), summed, "grp string, start int, i int, v double")
    sums = sums.groupBy("grp", "start", "i").agg(F.sum("v").alias("v"))
    lists = sums.groupBy("grp", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, sums = row["sums"][0], np.array(row["sums"])
                mean = sums[1 : P + 1] / n
                white, logdet = whitened(sums[P + 1 :].reshape(P, P) / n - np.outer(mean, mean))
                if logdet > row["logdet"] - RESTING:  # no step makes it worse but by rounding
                    out.append((row["grp"], row["start"], row["centre"], row["white"], row["logdet"], True))
                else:
                    out.append((row["grp"], row["start"], (mean + row["centre"]).tolist(), white.ravel().tolist(), logdet, False))
            yield _rows_of(_ESTIMATE_NAMES, out, _ESTIMATE_KINDS)

    return map_batches(known.select("grp", "start", "centre", "white", "logdet").join(lists, ["grp", "start"]), run, _ESTIMATE)


def minimum_determinant(blocks: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(grp, centre, white) of the half with the smallest determinant that the starts lead to; `white` whitens the
    scatter of all rows, as far as these are normal."""
    open_starts, rested = materialise(_starts(blocks), "estimate"), None
    best = Window.partitionBy("grp").orderBy("logdet", "start")  # four rows at most
    for turn in range(1, steps + 1):
        after = materialise(_step(blocks, open_starts, share), "estimate")
        still = after.where("rested")
        rested = still if rested is None else rested.unionByName(still)
        open_starts = after.where("not rested")
        if turn == FIRST_STEPS:
            ranked = open_starts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= STARTS_KEPT)
            open_starts = materialise(ranked.drop("place"), "estimate")
        if open_starts.isEmpty():
            break
    every = rested.unionByName(open_starts).withColumn("place", F.row_number().over(best)).where("place = 1")
    # Half of the rows alone spread less than all; for normal rows by this factor.
    factor = share / (1 - _chi_square_above(chi_square_quantile(share, P), P + 2))
    return every.select("grp", "centre", F.transform("white", lambda w: w / F.lit(math.sqrt(factor))).alias("white"))


def quality_table(
    docs: DataFrame, share: float = SHARE, beyond: float = BEYOND, least_rows: int = LEAST_ROWS
) -> DataFrame:
    """One row per document: its statistics, base_failed, and kept.

    A document that passes the base rules is judged by the narrowest of its groups with an estimate:
    language and source, language, all; a null language or source is a value of its own. Without any
    estimate (under `least_rows` rows in all) it is kept. Null and empty texts have no words and fail the
    base rules. Copies and repeated rows are judged alike and each returned; the doc_id may be null. Columns
    but doc_id, text, lang and source are not read. An empty table gives an empty one.
    """
    failed = (F.col("n_words") < SHORT) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    stats = materialise(statistics_table(docs).withColumn("base_failed", failed), "statistics")
    estimate = materialise(minimum_determinant(vector_blocks(stats, least_rows), share), "estimates")
    joined = stats.withColumns({f"grp{k}": name for k, name in enumerate(_groups())})
    for k in (0, 1):
        own = estimate.select(F.col("grp").alias(f"grp{k}"), F.struct("centre", "white").alias(f"e{k}"))
        joined = small_or_spread_join(joined, own, [f"grp{k}"])
    whole = estimate.where("grp = '1'").select("centre", "white").first()
    e2 = F.struct(*(F.array(*map(F.lit, v)).alias(n) for n, v in zip(("centre", "white"), whole))) if whole else F.lit(None)
    used = joined.withColumn("e", F.coalesce("e0", "e1", e2) if whole else F.coalesce("e0", "e1")).select("*", "e.centre", "e.white")
    distance = _distance([F.expr(e).cast("double") for e, _ in VECTOR])
    kept = ~F.col("base_failed") & F.coalesce(distance <= chi_square_quantile(1 - beyond, P), F.lit(True))
    return used.select("doc_id", *_STATISTICS[:5], "base_failed", kept.alias("kept"))


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance, from columns centre and white (rows of the whitening matrix, end to end)."""
    away = [x[i] - F.col("centre")[i] for i in range(P)]
    parts = [reduce(lambda a, b: a + b, (F.col("white")[P * i + j] * away[j] for j in range(P))) for i in range(P)]
    return reduce(lambda a, b: a + b, (part * part for part in parts))
