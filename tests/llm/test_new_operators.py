"""Collocations, whitening and packing against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodgetier.llm import collocations, cutting, queries, whitening


# Collocations


def plain_phrases(rows, least=10, top=2_000):
    found, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    found[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in found.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {q for p, a in chosen.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * f[q]}
        ranked = []
        for p, a in chosen.items():
            if p not in dropped:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def rows_for_phrases(docs):
    return [(r.lang, r.text) for r in docs.select("lang", "text").collect()]


@pytest.mark.parametrize("settings", [{}, {"least": 2, "top": 40, "block_bytes": 3_000, "bucket": 64}])
def test_phrases_like_a_plain_count(odd, clashing, given, settings):
    for docs in (odd, clashing, given):
        expected = plain_phrases(rows_for_phrases(docs), settings.get("least", 10), settings.get("top", 2_000))
        assert sorted(map(tuple, collocations.phrase_table(docs, **settings).collect())) == expected


def test_phrases_of_hot_words_ties_and_odd_spaces(spark):
    rows = [("en", "the cat\tsat  the cat. THE CAT,sat\x0bthe é É x\xa0y the cat")] * 30
    rows += [(None, "a b c; a b c: b c!d")] * 12 + [("und", "a b c")] * 3 + [("xx", None), ("xx", "")]
    rows += [("en", f"k{i} l{i} " * 11 + ".") for i in range(40)]  # forty equal scores
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (3, 50):
        assert sorted(map(tuple, collocations.phrase_table(docs, top=top).collect())) == plain_phrases(rows, top=top)


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, 2 * 10**13 + 3), (10, 11, 12), (10**13 - 1, 10**13 - 1, 10**13 - 1)]
    found = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    for r in found.collect():
        assert r.s == 1_000_000 * r.a * r.a // (r.l * r.r)


@pytest.mark.parametrize("width", [2, 3, 17, 21, 22, 31, 42])
def test_filters_lose_nothing(width):
    rng = np.random.default_rng(width)
    shuffle = collocations.Permutation(width)
    numbers = [rng.integers(0, 1 << width, 500) for _ in range(3)]
    high, low = shuffle.forward(*numbers)
    assert all((a == b).all() for a, b in zip(numbers, shuffle.back(high, low)))
    count = rng.integers(1, 1 << 40, 500)
    high, low, total = collocations.merged([(high, low, count), (high[:50], low[:50], count[:50])], shuffle.half)
    expected = Counter()
    for part in (slice(None), slice(50)):
        for one, two, three, n in zip(*(x[part].tolist() for x in numbers), count[part].tolist()):
            expected[one, two, three] += n
    for bits in (0, 2):
        got = {}
        bucket = high >> np.uint64(shuffle.half - bits)
        for b in np.unique(bucket).tolist():
            own = bucket == b
            data = collocations.to_filter(high[own], low[own], total[own], bits, shuffle.half)
            keys = collocations.from_filter(data, b, bits, shuffle.half)
            got |= dict(zip(zip(*(x.tolist() for x in shuffle.back(*keys[:2]))), keys[2].tolist()))
        assert got == expected


# Whitening


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    away = x - sums / n
    values, turn = np.linalg.eigh(away.T @ away / n)
    order = np.argsort(-values)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return n, away, values[order], turn[:, order], exact


def hold_against_plain(rows, found, components=32):
    """rows: (vec_id, vector) that take part, ids distinct."""
    n, away, values, turn, exact = plain_whitening([v for _, v in rows])
    listed = defaultdict(dict)
    for r in found.collect():
        listed[r.vec_id][r.component] = r
    assert set(listed) == {i for i, _ in rows}
    kept = min(components, int((values > 1e-9 * values[0]).sum()))
    got = np.array([[listed[i][k + 1].whitened for k in range(kept)] for i, _ in rows])
    expected = away @ turn[:, :kept] / np.sqrt(values[:kept])
    sign = np.sign((got * expected).sum(axis=0))
    assert np.abs(got - expected * sign).max() < 1e-6
    for (i, _), deviation in zip(rows, exact):
        assert len(listed[i]) == kept
        for k in range(kept):
            r = listed[i][k + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-6) and r.identity_error < 1e-6


def test_whitening_of_the_given_vectors(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if r.embedding is not None]
    hold_against_plain(rows, queries.op12_multiplicity_whitening(spark, sf))


def test_whitening_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    plain = [(i, rng.normal(0, 2, 5).tolist()) for i in range(200)]
    copies = [(1_000 + i, plain[0][1]) for i in range(100)]  # a third of all
    odd = [(2_000, None), (2_001, [1.0, None, 0.0, 0.0, 0.0]), (2_002, [float("nan")] + [0.0] * 4), (2_003, [float("inf")] + [0.0] * 4), (2_004, []), (2_005, [1.0, 2.0])]
    docs = spark.createDataFrame(plain + copies + odd, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("weight", F.lit(1))
    hold_against_plain(plain + copies, whitening.whitened_table(docs))
    hold_against_plain(plain + copies, whitening.whitened_table(docs, components=2), 2)


def test_whitening_fitted_on_distinct_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)]
    found = whitening.whitened_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), weights="one")
    assert found.first().n == 21 and found.count() == 100 and found.first().identity_error < 1e-9


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])]):
        assert whitening.whitened_table(spark.createDataFrame(rows, schema)).count() == 0
    flat = [(i if i else None, [float(i), 5.0, -float(i)]) for i in range(9)] * 2  # one component, repeated rows, a null id
    found = whitening.whitened_table(spark.createDataFrame(flat, schema)).collect()
    assert len(found) == 18 and {r.component for r in found} == {1} and sum(r.vec_id is None for r in found) == 2


def test_deviations_are_exact_up_to_64_bits_and_null_beyond():
    x = np.array([[0, 3], [1 << 31, 5], [1 << 60, 0]])
    sums = x.sum(axis=0).tolist()
    expected = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 3, sums) == [None, None, None] and min(expected) >= 1 << 63
    assert whitening.deviations(x[:2], 2, x[:2].sum(axis=0).tolist()) == [(1 << 62) + 4] * 2


# Packing


def hold_packing(rows, found, room=1_024):
    """rows: (doc_id, ids with the end id); found: rows of packed pieces."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        size = sum(n for _, n in parts)
        assert size == room or size < room and size & (size - 1) == 0
    expected = defaultdict(Counter)
    for doc_id, ids in rows:
        expected[doc_id][len(ids)] += 1
    whole = defaultdict(Counter)
    for doc_id, parts in documents.items():
        for start, n, crc, size in parts:
            whole[doc_id][size] += n
            assert any(zlib.crc32(ids[start : start + n].astype("<u4").tobytes()) == crc for other, ids in rows if other == doc_id and len(ids) == size)
    assert whole == {k: Counter({n: n * times for n, times in sizes.items()}) for k, sizes in expected.items()}
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.fixture(scope="module")
def byte_ids():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    return lambda text: np.append(library.encode(text or "", add_special_tokens=False).ids, 0).astype(np.int64)


def test_packed_pieces(odd, clashing, given, byte_ids):
    for docs in (odd, clashing, given):
        rows = [(r.doc_id, byte_ids(r.text)) for r in docs.select("doc_id", "text").collect()]
        hold_packing(rows, cutting.packed_pieces(docs).collect())


def test_sequences_hold_all_ids(given, byte_ids):
    found = cutting.sequences(given).collect()
    rows = [byte_ids(r.text) for r in given.select("text").collect()]
    held = np.concatenate([np.frombuffer(r.tokens, "<u2") for r in found])
    assert Counter(held.tolist()) == Counter(np.concatenate(rows).tolist())
    assert all(r.offsets[0] == 0 and len(r.offsets) == len(r.doc_ids) for r in found)


@pytest.mark.parametrize("seed", range(8))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    room = int(2 ** rng.integers(2, 9))
    histogram = np.zeros(room + 1, dtype=np.int64)
    some = rng.choice(np.arange(1, room + 1), rng.integers(1, room + 1), replace=False)
    histogram[some] = rng.integers(1, 200, len(some))
    made = cutting.plan(histogram, room)
    length = np.repeat(np.arange(room + 1), histogram)
    rank = np.concatenate([np.arange(n) for n in histogram])
    row, begin, size, sequence, offset = made.places(length, rank)
    taken = set()
    for values in zip(sequence.tolist(), offset.tolist(), size.tolist()):
        places = {(values[0], values[1] + k) for k in range(values[2])}
        assert not places & taken
        taken |= places
    assert len(taken) == length.sum() and (np.bincount(row, weights=size) == length).all()
    used = np.bincount(sequence, weights=size).astype(int)
    assert ((used == room) | (used & (used - 1) == 0)).all()


def test_column_generation_reaches_the_least_padding():
    """Thirds and halves fit together; greedy patterns alone pair them badly."""
    histogram = np.zeros(13, dtype=np.int64)
    histogram[[7, 5, 4, 3]] = 60, 20, 30, 40
    patterns, uses = cutting.solve(histogram, 12, padded=0.0)
    covered = Counter()
    for pattern, n in zip(patterns, uses):
        for length, each in pattern.items():
            covered[length] += each * n
    assert covered == pytest.approx({7: 60, 5: 20, 4: 30, 3: 40})
    sizes = cutting.padded_sizes(12)
    cost = sum(sizes[cutting._used(p)] * n for p, n in zip(patterns, uses))
    greedy = cutting.solve(histogram, 12, exchanges=0)
    assert cost <= sum(sizes[cutting._used(p)] * n for p, n in zip(*greedy))
    dual_bound = 4 * 30 + 60 * 12  # the fours alone need no padding, each seven keeps a sequence
    assert cost <= dual_bound + 1e-6


def test_knapsack_like_trying_everything():
    rng = np.random.default_rng(5)
    value = np.full(21, -np.inf)
    value[[3, 4, 7]] = rng.random(3)
    best, last = cutting.knapsack(value, 20)
    for size in range(21):
        tries = [a * value[3] + b * value[4] + c * value[7] for a in range(7) for b in range(6) for c in range(3) if 3 * a + 4 * b + 7 * c == size]
        assert best[size] == (pytest.approx(max(tries)) if tries else -np.inf)
        if tries:
            assert cutting._used(cutting._traced(last, size)) == size


def test_empty_tables_give_empty_ones(none, spark):
    for found in (collocations.phrase_table(none), cutting.packed_pieces(none), cutting.sequences(none)):
        assert found.count() == 0
