"""Quality classifier by co-training on two views of a document.

One classifier sees the text's content (rates of kinds of characters, of words said again, of lines said
again, lengths of words), the other the page's metadata (language, source, length). In every round each scores
all unlabelled documents and hands the other those it is surest of, as if they were labelled; its threshold is
a quantile of the scores of all of them. Afterwards both views are calibrated, and joined by a third logistic
curve, on labelled rows that took no part.

Of the labelled documents the first MOST_LABELLED in the order of a hash of their id are held by the driver.
Unlabelled ones stay in Spark: a pass counts their scores, another adds up the gradients and second derivatives
of both views over those handed over, a few thousand numbers. Who was handed over follows from the models and
thresholds of the rounds so far, so no pass leaves a state behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgetier.llm.base import map_batches, payload
from lodgetier.runtime import materialise

MOST_LABELLED = 30_000
ROUNDS = 4

#: Share of the unlabelled rows that a view may hand over per class and round, and how sure it must be.
HANDED = 0.02
SURE = 0.95

#: Bins that scores are counted in; steps of a fit at most, and the step at which it ends.
SCORE_BINS = 6_000
FIT_STEPS = 8
FITTED = 1e-2

#: Documents scored below are rejected.
THRESHOLD = 0.3

#: Places for sources and languages, by hash.
SOURCE_PLACES = 48
LANG_PLACES = 16
META = SOURCE_PLACES + LANG_PLACES + 2

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>=~^_{}[]\\@+",
    "bang": b"!?", "stop": b".,;:", "bar": b"|", "space": b" \t\r\n\v\f", "line": b"\n", "quote": b"\"'()/-",
}

#: Names of the content features.
CONTENT = [*_KINDS, "above_ascii", "word_length", "word_spread", "distinct", "said_again", "top_word", "line_again", "log_words"]


def content(text: bytes) -> list[float]:
    """The content features of a whole text."""
    n, words = max(1, len(text)), text.split()
    rates = [(len(text) - len(text.translate(None, kind))) / n for kind in _KINDS.values()]
    high = 1 - len(text.translate(None, bytes(range(128, 256)))) / n if text else 0.0
    if not words:
        return [*rates, high, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    lengths = np.fromiter(map(len, words), np.float64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return [
        *rates, high, lengths.mean() / 10, lengths.std() / 10, len(seen) / len(words) ** 0.8, again,
        max(seen.values()) / len(words), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words)) / 10,
    ]


def _metadata(lang: str | None, source: str | None, size: int) -> list[float]:
    out = [0.0] * META
    out[zlib.crc32(repr(source).encode()) % SOURCE_PLACES] = 1.0
    out[SOURCE_PLACES + zlib.crc32(repr(lang).encode()) % LANG_PLACES] = 1.0
    out[-2:] = np.log1p(size) / 10, (np.log1p(size) / 10) ** 2
    return out


def _features(text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[pa.Array, pa.Array]:
    texts = payload(text)
    page = zip(lang.cast(pa.string()).to_pylist(), source.cast(pa.string()).to_pylist(), map(len, texts))
    return pa.array([content(t) for t in texts], pa.list_(pa.float32())), pa.array([_metadata(*row) for row in page], pa.list_(pa.float32()))


def features(docs: DataFrame, *columns: str) -> DataFrame:
    """`columns` of every row with arrays `content` and `meta`; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features(batch.column("text"), batch.column("lang"), batch.column("source"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *found], [*columns, "content", "meta"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return map_batches(docs.select(*columns, "text", "lang", "source"), run, f"{kinds}content array<float>, meta array<float>")


#: Logits are held between minus and plus this.
WIDEST = 30.0

#: Largest change of a weight in a step.
MOST_MOVE = 1.0

#: Least scale of a feature: what the first rows have none of must not weigh any amount in later ones.
LEAST_SCALE = 0.02


class Logistic:
    """Ridge-regularised logistic regression on features standardised by the first rows it is fitted on."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-3):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), LEAST_SCALE)
        self.pull = np.append(np.full(x.shape[1], ridge), 1e-6)
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(100):
            if self.step(self.sums(x, y)) < 1e-7:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -WIDEST, WIDEST)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of rows, gradient and second derivatives, end to end; sums of parts add up."""
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -WIDEST, WIDEST)))
        return np.concatenate([[len(x)], z.T @ (p - y), ((z * (p * (1 - p) + 1e-9)[:, None]).T @ z).ravel()])

    def step(self, sums: np.ndarray) -> float:
        """A Newton step by such sums; the largest change of a weight."""
        n, k = sums[0], len(self.w)
        gradient, bend = sums[1 : k + 1] / n, sums[k + 1 :].reshape(k, k) / n
        move = np.linalg.solve(bend + np.diag(self.pull), gradient + self.pull * self.w)
        move *= min(1.0, MOST_MOVE / max(MOST_MOVE, float(np.abs(move).max())))  # a whole step may go too far
        self.w -= move
        return float(np.abs(move).max())

    def copy(self) -> Logistic:
        other = object.__new__(Logistic)
        other.mean, other.scale, other.pull, other.w = self.mean, self.scale, self.pull, self.w.copy()
        return other


#: A round: both views' models, and for each view the logits from which on rows count as bad and as good.
Round = tuple[list[Logistic], list[tuple[float, float]]]


def handed_over(views: list[np.ndarray], rounds: list[Round]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each view the label it gives every row, -1 for none, and which rows are left; a row goes once."""
    left = np.ones(len(views[0]), dtype=bool)
    given = [np.full(len(left), -1), np.full(len(left), -1)]
    for models, cuts in rounds:
        gone = np.zeros(len(left), dtype=bool)
        for own, model, x, (low, high) in zip(given, models, views, cuts):
            z = model.logit(x)
            for sure, label in ((left & (z <= low), 0), (left & (z >= high), 1)):
                own[sure] = label
                gone |= sure
        left &= ~gone
    return given, left


def thresholds(counts: np.ndarray, most: float) -> tuple[float, float]:
    """Logits that leave `most` rows or fewer below and above, by counts per bin, and are sure; where one bin
    holds more, the outermost sure bin goes whole, so that equal rows stay together."""
    edges = np.linspace(-WIDEST, WIDEST, len(counts) + 1)
    sure = np.log(SURE / (1 - SURE))

    def from_top(counts: np.ndarray) -> float:
        above = np.cumsum(counts[::-1])[::-1]  # rows in a bin or above it
        held = np.flatnonzero(counts)
        if not len(held):
            return np.inf
        fits = np.flatnonzero(above <= most)
        first = min(int(fits[0]) if len(fits) else len(counts), int(held[-1]))
        return max(edges[first], sure)

    return -from_top(counts[::-1]), from_top(counts)


def cotrain(views: list[np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS) -> list[Logistic]:
    """A classifier per view, from labelled rows and a table (content, meta) of unlabelled ones."""
    models = [Logistic(x, y) for x in views]
    whole = pool.count()
    done: list[Round] = []
    for _ in range(rounds if whole else 0):
        counts = _score_counts(pool, models, done)
        done = [*done, ([m.copy() for m in models], [thresholds(c, HANDED * whole) for c in counts])]
        before = [m.w.copy() for m in models]
        for _ in range(FIT_STEPS):
            sums = _handed_sums(pool, models, done)
            if max(m.step(m.sums(x, y) + s) for m, x, s in zip(models, views, sums)) < FITTED:
                break
        if all(np.array_equal(b, m.w) for b, m in zip(before, models)):
            break
    return models


def _views(batch: pa.RecordBatch, models: list[Logistic]) -> list[np.ndarray]:
    return [_matrix(batch.column(c), len(m.mean)) for c, m in zip(("content", "meta"), models)]


def _score_counts(pool: DataFrame, models: list[Logistic], done: list[Round]) -> list[np.ndarray]:
    """Rows not handed over yet, by view and bin of their logit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SCORE_BINS), dtype=np.int64)
        for batch in batches:
            views = _views(batch, models)
            left = handed_over(views, done)[1]
            for own, model, x in zip(total, models, views):
                bins = np.floor((model.logit(x[left]) + WIDEST) * (SCORE_BINS / 2 / WIDEST)).astype(np.int64)
                own += np.bincount(np.minimum(bins, SCORE_BINS - 1), minlength=SCORE_BINS)
        yield from _cells(total)

    return _added(pool, run, (2, SCORE_BINS))


def _handed_sums(pool: DataFrame, models: list[Logistic], done: list[Round]) -> list[np.ndarray]:
    """The sums of each view's model over the rows that the other view has handed it."""
    widths = [1 + len(m.w) + len(m.w) ** 2 for m in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, max(widths)))
        for batch in batches:
            views = _views(batch, models)
            given = handed_over(views, done)[0]
            for view, (model, x) in enumerate(zip(models, views)):
                label = given[1 - view]
                if (label >= 0).any():
                    total[view, : widths[view]] += model.sums(x[label >= 0], label[label >= 0])
        yield from _cells(total)

    return [s[:n] for s, n in zip(_added(pool, run, (2, max(widths))), widths)]


def _cells(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    place = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place].astype(float))], ["place", "v"])


def _added(pool: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """Cells of all tasks added up."""
    cells = map_batches(pool.select("content", "meta"), run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v"))
    out = np.zeros(shape)
    found = cells.toArrow()  # a few thousand numbers
    out.ravel()[found.column("place").to_numpy()] = found.column("v").to_numpy()
    return out


class Quality:
    """Both views' classifiers, their calibrations and the curve that joins them."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, kept: np.ndarray, pool: DataFrame, rounds: int):
        self.models = cotrain([x[~kept] for x in views], y[~kept], pool, rounds)
        logits = [m.logit(x[kept])[:, None] for m, x in zip(self.models, views)]
        self.calibrations = [Logistic(z, y[kept]) for z in logits]
        both = np.column_stack([c.logit(z) for c, z in zip(self.calibrations, logits)])
        self.join = Logistic(both, y[kept])

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        both = [c.logit(m.logit(x)[:, None]) for m, c, x in zip(self.models, self.calibrations, views)]
        return 1 / (1 + np.exp(-self.join.logit(np.column_stack(both))))


def _sample(found: DataFrame, ids: DataFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views and qualities of the rows of at most `most` ids, in the order of a hash of the id."""
    chosen = ids.withColumn("_order", F.xxhash64(F.lit(5), "doc_id")).orderBy("_order", "doc_id").limit(most)
    rows = found.join(F.broadcast(chosen), "doc_id").orderBy("_order", "doc_id", "content", "meta")  # `most` bounds it
    table = rows.select("content", "meta", "quality").toArrow().combine_chunks()
    views = [_matrix(table.column(c).combine_chunks(), n) for c, n in (("content", len(CONTENT)), ("meta", META))]
    return views, table.column("quality").to_numpy(zero_copy_only=False).astype(np.float64)


def _matrix(arrays: pa.Array, width: int) -> np.ndarray:
    if isinstance(arrays, pa.ChunkedArray):
        arrays = pa.concat_arrays(arrays.chunks) if arrays.num_chunks else pa.array([], arrays.type)
    return arrays.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


def fit(found: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Quality | None:
    """A model from the features of all documents and their labels; None without labels of both classes.

    Null labels are left out; a doc_id with several counts as good if one says so.
    """
    truth = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    ids = found.where("doc_id is not null").select("doc_id").distinct().join(truth.hint("merge"), "doc_id", "left")
    views, y = _sample(found, ids.where("quality is not null"), MOST_LABELLED)
    kept = np.arange(len(y)) % 4 == 0  # calibrates; the sample is in hash order
    if any(len(set(y[side].tolist())) < 2 for side in (kept, ~kept)):
        return None
    labelled = truth.select("doc_id").hint("merge")
    pool = materialise(found.join(labelled, "doc_id", "left_anti").select("content", "meta"), "unlabelled")
    return Quality(views, y, kept, pool, rounds)


def _score(model: Quality | None, content: pa.Array, meta: pa.Array) -> np.ndarray:
    """Scores from arrays of features; without a model every document is good."""
    n = len(content)
    if model is None or not n:
        return np.ones(n)
    return model.score([_matrix(content, len(CONTENT)), _matrix(meta, META)])


def quality_scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, score, kept) for every row of `docs`; score is the probability of quality 1.

    Without labels of both classes on both sides of the split every document has score 1 and is kept. A null
    text counts as empty, null language and source as values of their own; lang and source may hold anything.
    Copies are scored alike but for their metadata, repeated rows are each returned, null doc_ids passed
    on. An empty table gives an empty one. Other columns are not read.
    """
    found = materialise(features(_narrow(docs), "doc_id"), "features")
    model = fit(found, labels, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score(model, batch.column("content"), batch.column("meta"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(score >= THRESHOLD)], ["doc_id", "score", "kept"]
            )

    return map_batches(found, run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The rows of `docs` that score `THRESHOLD` or more, with all their columns.

    Each row is scored where it is read, so texts are not moved. Rules are those of `quality_scores`.
    """
    model = fit(materialise(features(_narrow(docs), "doc_id"), "features"), labels, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = _features(batch.column("text"), batch.column("lang"), batch.column("source"))
            yield batch.filter(pa.array(_score(model, first, second) >= THRESHOLD))

    return map_batches(docs, run, docs.schema)
