"""Mixing, sharding, outliers, toxicity, quality and neighbours against plain versions, and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodgetier.llm import cotrain, mixing, outliers, queries, sharding, toxicity, vptree


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight, what is above a limit reshared until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(odd, clashing, given):
    for docs in (odd, clashing, given):
        found = mixing.mix_table(docs).collect()
        rows = docs.select("doc_id", "source", "text").collect()
        size = [len((r.text or "").encode().split()) for r in rows]
        assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((r.doc_id, r.source, n) for r, n in zip(rows, size))
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in found:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r["size"]
        target = plain_targets(sizes)
        for r in found:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        for source, n in taken.items():
            assert abs(n - target[source]) <= 0.5 + 1e-6
        assert sorted(map(tuple, mixing.mix_table(docs).collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_targets_without_limits_keep_the_weights(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100), (None, 100)], "source string, size long")
    found = {r.source: r.target for r in mixing.targets(rows, share=0.5).collect()}
    assert found == pytest.approx({"a": 600 / 9, "b": 200 / 9, "c": 400 / 9, None: 600 / 9})


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(n):
    for key in (1, 99):
        found = mixing.permuted(np.arange(n), n, np.full(n, key, np.uint64))
        assert sorted(found.tolist()) == list(range(n))


def test_slots_take_every_block_equally_often(given):
    mix = mixing.Mix(given.select("doc_id", "source", "text"))
    times = defaultdict(Counter)
    for r in mix.slots.collect():
        times[r.source][r.block] += 1
    for r in mix.targets.collect():
        blocks = -(-r.source_size // mixing.BLOCK_WORDS)
        counts = [times[r.source][b] for b in range(blocks)]
        assert max(counts) - min(counts) <= 1 and abs(sum(counts) - r.target / mixing.BLOCK_WORDS) <= 4


def test_small_sources_give_their_target(spark):
    rows = [(i, "w " * 5, f"s{i:02}") for i in range(12)] + [(100, "w " * 33, "t"), (101, "w " * 4_000, None), (102, None, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = plain_targets({r[2]: len((r[1] or "").split()) for r in rows})
    found = {r.source: r for r in mixing.mix_table(docs).collect()}
    assert found["s00"].taken == 10 and found["t"].taken == 66 and found["u"].taken == 0
    for source, r in found.items():
        assert abs(r.taken - target[source]) <= 0.5


@pytest.mark.parametrize("seed", range(3))
def test_owed_slots_hold_the_words_exactly(seed):
    rng = np.random.default_rng(seed)
    for _ in range(500):
        size, block = int(rng.integers(1, 400)), int(rng.integers(1, 40))
        words, base, n = int(rng.integers(1, 2 * size + 1)), int(rng.integers(1 << 60)), -(-size // block)
        total, last = mixing.owed_slots(size, words, block, base)
        at = mixing.permuted(np.arange(total) % n, n, mixing._round_key(base, np.arange(total) // n))
        held = np.where(at == n - 1, size - (n - 1) * block, block)
        assert 0 < last and held[:-1].sum() + min(last, held[-1]) == words


def test_shards_are_put_together_from_the_draw(given):
    docs = given.select("doc_id", "source", "text")
    found = mixing.mixed_shards(docs, shards=4).collect()
    words, sizes = defaultdict(int), defaultdict(Counter)
    for r in found:
        words[r.source] += len(r.text.encode().split())
        sizes[r.shard][r.source] += 1
    for shard in range(4):
        assert sorted(r.place for r in found if r.shard == shard) == list(range(sum(sizes[shard].values())))
    mix = mixing.Mix(docs, shards=4)
    for r in mix.targets.collect():
        assert words[r.source] == round(r.target)
    drawn = Counter((r.shard, r.source) for r in mix.slots.collect())
    assert drawn == {(shard, s): n for shard, c in sizes.items() for s, n in c.items()}
    held = {w for r in docs.collect() for w in (r.text or "").encode().split()}
    assert all(w in held for r in found for w in r.text.encode().split())


def test_mixed_documents_hold_the_words_taken(odd, clashing, given):
    for docs in (clashing, given):
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        words = Counter()
        source = {(r.doc_id, w) for r in docs.select("doc_id", "text").collect() for w in (r.text or "").encode().split()}
        for r in mixed.collect():
            found = r.text.encode().split()
            words[r.doc_id] += len(found)
            assert found and all((r.doc_id, w) in source for w in found) and r.n_chars == len(r.text)
        taken = Counter()
        for r in mixing.mix_table(docs).collect():
            taken[r.doc_id] += r.taken
        if docs is given:
            assert +words == +taken


def test_take():
    text = b" a b\n c  d e "
    assert mixing._take(text, [(0, 2), (3, 5)]) == "a b d e"
    assert mixing._take(text, [(0, 3)]) == "a b\n c"
    assert mixing._take(text, [(0, 5)]) == text.decode()
    assert mixing._times([{"begin": 0, "end": 2, "times": 2}, {"begin": 2, "end": 3, "times": 1}]) == [[(0, 3)], [(0, 2)]]


def test_shards(odd, clashing, given):
    for docs in (odd, clashing, given):
        rows = sharding.shard_table(docs).collect()
        texts = docs.select("doc_id", "text").collect()
        expected = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in texts)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
        slots = defaultdict(list)
        for r in rows:
            assert r.law == "rows" and r.grown_shard is None
            slots[r.shard].append(r.slot)
        counts = [len(slots[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffle_is_uniform_over_shards_and_blocks(spark):
    rows = spark.range(4_000).withColumnRenamed("id", "doc_id")
    found = sharding.shuffle_into_shards(rows, 4, rows_per_block=250).toPandas()
    assert sorted(found.groupby("shard").slot.nunique()) == [1000] * 4
    place = found.shard * 1_000 + found.slot
    assert abs(np.corrcoef(found.doc_id, place)[0, 1]) < 0.06
    halves = found.groupby([found.doc_id // 1_000, "shard"]).size()
    assert halves.min() > 190 and halves.max() < 310  # 250 each, some 4 deviations


def test_communication_matrix_is_hypergeometric():
    rows, columns = [30, 0, 50, 20], [40, 35, 25]
    drawn = np.array([sharding.communication_matrix(rows, columns, seed) for seed in range(4_000)])
    assert (drawn.sum(axis=2) == rows).all() and (drawn.sum(axis=1) == columns).all()
    mean = np.outer(rows, columns) / 100
    assert np.abs(drawn.mean(axis=0) - mean).max() < 0.2
    variance = 30 * 0.4 * 0.6 * 70 / 99
    assert drawn[:, 0, 0].var() == pytest.approx(variance, rel=0.1)
    huge = sharding.communication_matrix([10**11, 10**11], [10**11, 10**11], 1)
    assert (huge.sum(axis=0) == 10**11).all() and (huge.sum(axis=1) == 10**11).all()


def plain_statistics(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    base = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))
    return (*base, base[0] < 20 or 100 * base[4] > 30 * base[0])


def test_quality_rules(odd, clashing, given):
    for docs in (odd, clashing, given):
        rows = docs.select("doc_id", "text").collect()
        found = outliers.quality_table(docs).collect()
        expected = Counter((r.doc_id, *plain_statistics(r.text)) for r in rows)
        assert Counter(tuple(r)[:7] for r in found) == expected
        assert not any(r.kept and r.base_failed for r in found)


def test_outliers_are_rejected_and_others_kept(spark):
    pick = np.random.default_rng(1)
    rows = []
    for i in range(900):
        words = ["w" * k for k in pick.integers(2, 9, 200)]
        junk = i % 9 == 0
        rows.append((i, " ".join(w + "&" * 3 * junk + str(k) for k, w in enumerate(words)), "en", "ab"[i % 2]))
    found = outliers.quality_table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert all(r.kept == (r.doc_id % 9 != 0) for r in found.collect())


def vector_table(spark, groups):
    """Blocks of given vectors by group."""
    rows = [(g, i, np.ascontiguousarray(part, dtype=float).tobytes()) for g, x in groups.items() for i, part in enumerate(np.array_split(x, 3))]
    return spark.createDataFrame([(g, i, bytearray(b)) for g, i, b in rows], "grp string, salt long, x binary")


def least_determinant(x, h):
    """The half with the smallest determinant among all halves."""
    from itertools import combinations

    return min((outliers.whitened(np.cov(x[list(c)].T, bias=True))[1], c) for c in combinations(range(len(x)), h))


def test_a_third_of_planted_junk_is_rejected(spark):
    pick = np.random.default_rng(1)
    template = " ".join("x&#" * 2 + str(k % 3) + "|" * (k % 4) for k in range(90))
    rows = []
    for i in range(900):
        words = ["w" * k for k in pick.integers(2, 9, 200)]
        text = " ".join(w + str(k) for k, w in enumerate(words))
        rows.append((i, template if i % 3 == 0 else text, "en", "ab"[i % 2]))
    # copies differ in their last words, as templates do
    rows = [(i, t + f" n{i} m{i * 7}" if i % 3 == 0 else t, lang, s) for i, t, lang, s in rows]
    found = outliers.quality_table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(not r.kept for r in found if r.doc_id % 3 == 0)
    assert sum(r.kept for r in found if r.doc_id % 3) >= 598


def test_estimates_like_a_search_over_all_halves(spark):
    pick = np.random.default_rng(2)
    least = np.array([low for _, low in outliers.VECTOR])
    groups = {}
    for k in range(4):
        x = pick.normal(size=(16, outliers.P)) * 20 * least
        x[:4] += 400 * least * pick.choice([-1, 1], outliers.P)
        groups[f"g{k}"] = x
    groups["ties"] = np.repeat(groups["g0"], 2, axis=0)[:16]
    found = {r.grp: r for r in outliers.minimum_determinant(vector_table(spark, groups)).collect()}
    h = -(-(16 + outliers.P + 1) // 2)
    for name, x in groups.items():
        if name == "ties":
            continue
        logdet, rows = least_determinant(x, h)
        white = np.array(found[name].white).reshape(outliers.P, outliers.P)
        factor = outliers.SHARE / (1 - outliers._chi_square_above(outliers.chi_square_quantile(outliers.SHARE, outliers.P), outliers.P + 2))
        got = -2 * np.linalg.slogdet(white * np.sqrt(factor) * least)[1]
        assert got == pytest.approx(logdet, abs=1.5)  # steps from four starts, against every half
        assert not set(rows) & set(range(4)) and np.abs((found[name].centre - x[4:].mean(axis=0)) / least).max() < 40


def test_rows_of_the_last_bin_count_by_share(spark):
    """Equal vectors lie in one bin; half of the weight is taken whatever their number."""
    x = np.zeros((40, outliers.P))
    x[30:] += np.arange(1, 11)[:, None]
    blocks = vector_table(spark, {"g": x})
    starts = outliers._starts(blocks).where("start = 0")
    after = outliers._step(blocks, outliers.materialise(starts, "test"), 0.5).first()
    assert np.allclose(after.centre, 0, atol=0.01) and after.logdet == 0.0


def test_large_groups_estimate_like_plain_concentration(spark):
    pick = np.random.default_rng(3)
    least = np.array([low for _, low in outliers.VECTOR])
    x = pick.normal(size=(4_000, outliers.P)) * 10 * least
    x[:1_300] = 300 * least + pick.normal(size=(1_300, outliers.P)) * least
    found = outliers.minimum_determinant(vector_table(spark, {"g": x})).first()
    white = np.array(found.white).reshape(outliers.P, outliers.P)
    away = (((x - found.centre) @ white.T) ** 2).sum(axis=1)
    cut = outliers.chi_square_quantile(1 - outliers.BEYOND, outliers.P)
    assert (away[:1_300] > cut).all() and (away[1_300:] > cut).mean() < 0.005


def test_chi_square():
    assert outliers.chi_square_quantile(0.95, 6) == pytest.approx(12.5916, abs=1e-3)
    assert outliers.chi_square_quantile(0.5, 2) == pytest.approx(2 * np.log(2), abs=1e-6)


def planted(n, seed, bad=("zorgul", "zorgulak", "mobrin")):
    import random

    from conftest import prose

    pick, rows = random.Random(seed), []
    for i in range(n):
        words = prose(60, seed * 100_000 + i).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[pick.randrange(60)] = pick.choice(bad)
        rows.append((i, " ".join(words), "en", "a", int(toxic), 1))
    return rows


@pytest.fixture(scope="module")
def marked(spark):
    return spark.createDataFrame(planted(800, 1), "doc_id long, text string, lang string, source string, toxic int, quality int")


def test_toxicity_on_rows_held_out(marked):
    found = toxicity.toxicity_table(marked.select("doc_id", "text"), marked.select("doc_id", "toxic")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found) and len(found) == 800
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_toxicity_knows_new_forms_of_a_stem(spark, marked):
    new = spark.createDataFrame([(10_001, "alpha beta zorgulend gamma delta mobrina eta"), (10_002, "alpha beta theta gamma delta iota eta")], "doc_id long, text string")
    docs = marked.select("doc_id", "text").unionByName(new)
    score = {r.doc_id: r.score for r in toxicity.toxicity_table(docs, marked.select("doc_id", "toxic")).where("doc_id > 10000").collect()}
    assert score[10_001] > 0.7 > 0.3 > score[10_002]


def plain_ratios(rows, order=toxicity.ORDER, discount=toxicity.DISCOUNT, less=toxicity.CLASS_DISCOUNT):
    """Log ratios by string, counted in dictionaries; rows are (text, toxic)."""
    counts = defaultdict(lambda: [0, 0])
    for text, toxic in rows:
        for w in set(text.split()):
            padded = "\x01" * (order - 1) + w.lower() + "\x02"
            for i in range(len(padded) - order + 1):
                counts[padded[i : i + order]][toxic] += 1
    strings, shared = {order: set(counts)}, {}
    for k in range(order - 1, 0, -1):
        strings[k] = {x[1:] for x in strings[k + 1]}
    low = {"": 1 / len(strings[1])}
    for k in range(1, order):
        kinds = Counter(x[1:] for x in strings[k + 1])
        total, types = Counter(), Counter(x[:-1] for x in kinds)
        for x, n in kinds.items():
            total[x[:-1]] += n
        low = {
            x: (max(n - discount, 0) + discount * types[x[:-1]] * low[x[1:]]) / total[x[:-1]] for x, n in kinds.items()
        }

    def evidence(n, d):
        total, left = Counter(), Counter()
        for x, c in n.items():
            total[x[:-1]] += c
            left[x[:-1]] += max(c - d, 0)
        passed = {x: 1 - left[x[:-1]] / total[x[:-1]] if total[x[:-1]] else 1.0 for x in n}
        return {x: max(c - d, 0) / max(left[x[:-1]], 1e-9) for x, c in n.items()}, passed

    own, passed = evidence({x: sum(c) for x, c in counts.items()}, discount)
    (ordinary, a), (toxic, b) = (evidence({x: c[k] for x, c in counts.items()}, less) for k in (0, 1))
    for x in counts:
        pooled, down = (1 - passed[x]) * own[x] + passed[x] * low[x[1:]], max(a[x], b[x])
        shared[x] = np.log((1 - down) * toxic[x] + down * pooled) - np.log((1 - down) * ordinary[x] + down * pooled)
    return shared


def plain_difference(text, ratio, order=toxicity.ORDER):
    found = []
    for w in text.split():
        padded = "\x01" * (order - 1) + w.lower() + "\x02"
        found.append(max(sum(ratio.get(padded[i : i + order], 0.0) for i in range(len(padded) - order + 1)) - toxicity.MARGIN, 0.0))
    return np.log(toxicity.FLOOR + (sum(found) / len(found) if found else 0.0))


def test_ratios_and_differences_like_counts_of_strings(spark, marked):
    rows = [(r.text, r.toxic) for r in marked.collect()]
    ratio = toxicity.materialise(toxicity.ratios(toxicity.materialise(toxicity.gram_counts(marked), "test")), "test")
    expected = plain_ratios(rows)
    assert sorted(r.ratio for r in ratio.collect()) == pytest.approx(sorted(expected.values()), abs=1e-9)
    texts = [t for t, _ in rows[:50]] + ["", None, "quite unmet zorgulend"]
    docs = spark.createDataFrame([(None if i % 10 == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for size in (1 << 20, 500):
        found = toxicity.differences(docs, ratio, "doc_id", "text", size=size).collect()
        assert len(found) == len(texts)
        assert all(r.difference == pytest.approx(plain_difference(r.text or "", expected), abs=1e-9) for r in found)


def test_strings_are_told_apart_however_many():
    pick = np.random.default_rng(7)
    words = sorted({"".join(map(chr, w)) for w in pick.integers(97, 123, (100_000, 5))})
    hashes = toxicity.windows(words)[0]
    plain = {("\x01" * 4 + w + "\x02")[i : i + 5] for w in words for i in range(6)}
    assert len(np.unique(hashes)) == len(plain)


def test_labels_of_held_out_rows_do_not_matter(marked):
    labels = marked.select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = marked.select("doc_id", "text")
    one, two = (sorted(map(tuple, toxicity.toxicity_table(docs, x).collect())) for x in (labels, turned))
    assert one == two


def test_toxicity_of_odd_rows(odd, clashing, labels, none):
    for docs in (odd, clashing):
        found = toxicity.toxicity_table(docs, labels).collect()
        assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd.collect())
    assert toxicity.toxicity_table(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_table(odd, labels.where("false")).collect()} == {0.0}


def test_quality_on_the_given_rows(given, labels):
    scored = cotrain.quality_scores(given, labels).join(labels, "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in scored)
    assert right >= 0.95 * len(scored)
    assert sum(r.quality == 1 and not r.kept for r in scored) <= 0.03 * len(scored)


def test_quality_of_odd_rows(odd, clashing, labels, none):
    assert Counter(r.doc_id for r in cotrain.quality_scores(odd, labels).collect()) == Counter(r.doc_id for r in odd.collect())
    assert cotrain.quality_scores(none, labels).count() == 0
    everything = cotrain.keep_good(clashing, labels.where("false"))
    assert everything.columns == clashing.columns and everything.count() == odd.count()


def pool_table(spark, views):
    rows = [(a.tolist(), b.tolist()) for a, b in zip(*views)]
    return spark.createDataFrame(rows, "content array<double>, meta array<double>").repartition(3)


def plain_cotrain(views, y, pool, rounds):
    """Co-training on arrays: every round both views hand over, then each is fitted on all it has."""
    models = [cotrain.Logistic(x, y) for x in views]
    own, left = [[(x, y)] for x in views], np.ones(len(pool[0]), bool)
    for _ in range(rounds):
        chosen = []
        for model, x in zip(models, pool):
            z = model.logit(x)
            bins = np.minimum(np.floor((z[left] + 30) * cotrain.SCORE_BINS / 60).astype(int), cotrain.SCORE_BINS - 1)
            low, high = cotrain.thresholds(np.bincount(bins, minlength=cotrain.SCORE_BINS), cotrain.HANDED * len(left))
            chosen.append((left & (z <= low), left & (z >= high)))
        for view in (0, 1):
            for label, rows in enumerate(chosen[1 - view]):
                own[view].append((pool[view][rows], np.full(rows.sum(), float(label))))
        for pair in chosen:
            left &= ~(pair[0] | pair[1])
        for model, parts in zip(models, own):
            for _ in range(60):
                if model.step(model.sums(*(np.concatenate(c) for c in zip(*parts)))) < 1e-9:
                    break
    return models


def test_views_teach_each_other_like_a_plain_version(spark):
    pick = np.random.default_rng(3)
    y = pick.integers(0, 2, 4_000).astype(float)
    views = [y[:, None] * 3 + pick.normal(size=(4_000, 2)) for _ in range(2)]
    few = slice(0, 30)
    rest = [v[30:3_000] for v in views]
    alone = cotrain.Logistic(views[0][few], y[few])
    taught = cotrain.cotrain([v[few] for v in views], y[few], pool_table(spark, rest), rounds=3)
    for model, plain in zip(taught, plain_cotrain([v[few] for v in views], y[few], rest, 3)):
        assert np.abs(model.w - plain.w).max() < 0.02 * np.abs(plain.w).max()
    right = [((m.logit(views[0][3_000:]) > 0) == y[3_000:]).mean() for m in (alone, taught[0])]
    assert right[1] >= right[0] - 0.01 and right[1] > 0.9


def test_thresholds_are_quantiles_of_all_rows():
    counts = np.zeros(cotrain.SCORE_BINS, dtype=int)
    counts[-100:], counts[:50] = 10, 4  # 1,000 good, 200 bad
    low, high = cotrain.thresholds(counts, 95)
    width = 60 / cotrain.SCORE_BINS
    assert high == pytest.approx(30 - 9 * width) and low == pytest.approx(-30 + 23 * width)
    counts[:] = 0
    counts[-5] = 1_000  # equal rows stay together
    assert cotrain.thresholds(counts, 95)[1] == pytest.approx(30 - 5 * width)
    counts[:] = 0
    counts[cotrain.SCORE_BINS // 2] = 1_000  # none is sure
    assert cotrain.thresholds(counts, 95)[1] >= np.log(19) - 1e-9


def test_every_unlabelled_row_may_teach(spark):
    """Rows of a kind that only few unlabelled documents have, wherever they come in any order, are handed over."""
    pick = np.random.default_rng(4)
    y = np.repeat([0.0, 1.0], 200)
    views = [y[:, None] * 4 + pick.normal(size=(400, 2)) for _ in range(2)]
    rare = [np.full((3, 2), 9.0), np.full((3, 2), 1.0)]
    pool = [np.concatenate([pick.normal(size=(3_000, 2)), r]) for r in rare]
    models = [cotrain.Logistic(x, y) for x in views]
    counts = cotrain._score_counts(pool_table(spark, pool), models, [])
    rounds = [(models, [cotrain.thresholds(c, cotrain.HANDED * 3_003) for c in counts])]
    given, left = cotrain.handed_over(pool, rounds)
    assert (given[0][-3:] == 1).all() and not left[-3:].any()
    assert int(counts[0].sum()) == 3_003


def plain_nearest(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float64)
    out = []
    for q, a in good.items():
        if q % every:
            continue
        found = []
        for i, b in good.items():
            if i != q and len(a) == len(b):
                score = 0.0
                for x, y in zip(a.tolist(), b.tolist()):
                    score += x * y
                found.append((-score, i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_neighbours_of_the_given_vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = vptree.neighbour_table(rows).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, found.collect())) == plain_nearest([(r.vec_id, r.embedding) for r in rows.collect()], 20, 20)


def test_neighbours_of_odd_vectors(spark):
    pick = np.random.default_rng(4)
    rows = [(i, pick.normal(size=6).round(2).tolist()) for i in range(900)]
    rows += [(i, [1.0, 0.0, 0.5, 0.0, 0.0, 0.0]) for i in range(900, 960)]  # ties
    rows += [(1_000, None), (1_020, [0.0] * 6), (1_040, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (1_060, [float("nan")] * 6), (1_080, [float("inf")] + [0.0] * 5)]
    rows += [(1_100, [1.0, 2.0]), (1_101, [2.0, 1.0]), (None, [1.0] * 6), (940, [1.0, 0.0, 0.5, 0.0, 0.0, 0.0]), (1_120, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    queries_ = table.where("vec_id % 20 = 0")
    small = vptree.nearest(table, queries_, 20, shard_rows=200, query_rows=7).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, small.collect())) == plain_nearest(rows, 20, 20)
    assert vptree.nearest(table.where("false"), queries_.where("false"), 5).count() == 0


def test_a_larger_factor_leaves_out_more():
    pick = np.random.default_rng(5)
    rows = np.concatenate([pick.normal(size=(300, 8)) + 8 * pick.normal(size=8) for _ in range(20)])
    top = float(np.linalg.norm(rows, axis=1).max())
    order, nodes = vptree.build(rows, top, leaf=32)
    names = np.arange(40) * 100
    score = rows[names] @ rows.T
    score[np.arange(40), names] = -np.inf
    exact = np.argsort(-score, axis=1, kind="stable")[:, :10]
    recall = []
    for factor in (1.0, 1.05, 1.5, 1e9):
        found, _ = vptree.Search(order, rows[order], nodes, top, 10, factor).run(names, rows[names])
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), found.tolist())]))
    assert recall[0] == 1.0 and recall == sorted(recall, reverse=True) and recall[3] < 1.0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("ids").collect())) == sorted(map(tuple, docs.drop("ids").collect()))


def test_pipeline_of_odd_and_empty_rows(spark, sf, clashing, none):
    for start, rows in ((clashing, 5), (none, 0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() >= rows) and (rows or not docs.count())


def test_queries_are_numbered_one_to_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
