"""BPE, token files, near-duplicates and repeated passages against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lodgetier.llm import bpe, packing, simhash, suffix
from lodgetier.llm.components import components

PARTS = [
    "a", "aa", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "é", "'s", "'re", "12", "½", "漢字", "😀", "<|endoftext|>",
    "<|ENDOFTEXT|>", "<|endo", "!!", "...", "the", " the", ".", ",", "Å,", "×.", "\xa0", "​", "İ", "ß", "ΑΣ", "\x00", "\r\n", "word" * 9,
]


def fuzz(n, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize("module, encoder", [(bpe, bpe.encoder), (packing, packing.word_encoder)])
def test_encodes_like_the_library(module, encoder):
    library = Tokenizer.from_file(module.VOCABULARY)
    texts = fuzz(3_000)
    for text, ids in zip(texts, encoder(module.VOCABULARY).encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("module, encoder", [(bpe, bpe.encoder), (packing, packing.word_encoder)])
def test_chunks_of_neighbouring_sizes_are_told_apart(module, encoder):
    library = Tokenizer.from_file(module.VOCABULARY)
    for size in range(14, 18):
        chunk = " understandingssss"[:size]
        for texts in ([chunk, chunk + ">"], [chunk + ">", chunk], [chunk + "\x00", chunk]):
            found = encoder(module.VOCABULARY).encode([t.encode() for t in texts])
            assert [ids.tolist() for ids in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_chunk_keys_and_sizes_say_all_of_sixteen_bytes():
    from lodgetier.llm.chunks import ChunkStore

    learn = lambda chunks: (np.frombuffer(b"".join(chunks), np.uint8).astype(np.int32), np.array([len(c) for c in chunks]))
    for size in range(14, 18):
        store = ChunkStore(learn, lambda text: True, lambda text: np.frombuffer(text, np.uint8).astype(np.int32))
        chunk = b" understandingssss"[:size]
        for texts in ([chunk, chunk + b">"], [chunk + b">", chunk + b"\x00", chunk]):
            assert [bytes(ids.tolist()) for ids in store.encode(texts)] == texts


def test_encoder_forgets_and_learns_again():
    library, own = Tokenizer.from_file(bpe.VOCABULARY), bpe.Encoder(bpe.vocabulary(bpe.VOCABULARY))
    own.store.kept = 10
    for seed in range(5):
        texts = fuzz(50, seed)
        assert [i.tolist() for i in own.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def expected_bpe(text):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_table(odd, clashing):
    expected = sorted([(r.doc_id, *expected_bpe(r.text)) for r in odd.collect()], key=repr)
    assert sorted(map(tuple, bpe.bpe_table(odd).collect()), key=repr) == expected
    assert sorted(map(tuple, bpe.bpe_table(clashing).collect()), key=repr) == expected


def test_bpe_decodes_what_it_encoded(odd):
    back = bpe.decode_table(bpe.bpe_table(odd, with_ids=True))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(r.doc_id, r.text or "") for r in odd.collect()], key=repr)


def test_simple8b_round_trip():
    pick = np.random.default_rng(1)
    for k in range(300):
        n = int(pick.integers(0, 400))
        ids = pick.integers(0, 1 << 62, n, dtype=np.uint64) >> pick.integers(0, 63, n, dtype=np.uint64)
        if k % 3 == 0 and n > 120:
            ids[20 : 20 + int(pick.integers(0, 99))] = 0
        if k % 5 == 0 and n:
            ids[int(pick.integers(0, n))] = np.uint64(2**64 - 1)
        words, escapes = packing.pack(ids)
        assert (packing.unpack(words, escapes, n) == ids).all()


def expected_ids(rows):
    library, start, out = Tokenizer.from_file(packing.VOCABULARY), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, packing.END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_ids_table(odd, clashing, given):
    for docs in (odd, clashing, given):
        found = packing.ids_table(docs).collect()
        expected = expected_ids([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points):
    """Smallest reachable id by a plain search; points are (id, fingerprint), ids may be null."""
    label = {f: min(i for i, g in points if g == f and i is not None) for _, f in points if any(i is not None for i, g in points if g == f)}
    near = {f: [g for g in label if bin(f ^ g).count("1") <= 3] for f in label}
    changed = True
    while changed:
        changed = False
        for f in label:
            low = min(label[g] for g in near[f])
            if low < label[f]:
                label[f], changed = low, True
    return label


def test_near_duplicates(odd, clashing, given):
    for docs in (odd, clashing, given):
        points = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        label = plain_components(points)
        expected = sorted([(i, f"{f:016x}", label.get(f)) for i, f in points], key=repr)
        assert sorted(map(tuple, simhash.near_duplicate_table(docs).collect()), key=repr) == expected


@pytest.mark.parametrize("tile", [5, 2_048])
def test_links_are_complete(spark, tile):
    pick = random.Random(5)
    centres = [pick.getrandbits(64) for _ in range(12)]
    found = set()
    for _ in range(900):
        fp = pick.choice(centres)
        for _ in range(pick.randrange(5)):
            fp ^= 1 << pick.randrange(64)
        found.add(fp)
    found = sorted(found)
    points = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(found)], "fp long, node long")
    roots = {r.node: r.root for r in components(simhash.linked(points, tile=tile)).collect()}
    expected = plain_components(list(enumerate(found)))
    assert [roots.get(i, i) for i in range(len(found))] == [expected[f] for f in found]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    links = spark.createDataFrame([*chain, *star, (5000, 5000)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}
    assert components(links.where("false")).count() == 0


def test_keep_one_of_each(odd, clashing):
    kept = simhash.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # rows without id link like any other: one copies document 5, one has no words like document 1
    assert {1, 4, 5, 8}.issubset(ids) and not {2, 3, 6, 7, None} & set(ids)


def test_one_row_of_each_component_stays(spark):
    from conftest import prose

    one, two, three = (prose(150, n) for n in (71, 72, 73))
    rows = [(1, one, "b"), (1, one, "a"), (2, one, "a"), (3, two, "a"), (3, three, "a"), (4, two, "a"), (0, three, "a")]
    rows += [(None, "nameless " + one, "a"), (None, "nameless " + one, "a")]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(
        [(1, one, "a"), (3, two, "a"), (0, three, "a"), (None, "nameless " + one, "a")], key=repr
    )


def test_rows_without_id_and_of_one_id_are_linked_like_any_other(spark):
    from conftest import prose

    one, two = prose(400, 81), prose(400, 82)
    near = next(
        t for i in range(400) for t in [" ".join(w if k != i else "odd" for k, w in enumerate(one.split()))]
        if 1 <= (simhash.fingerprint(t.encode()) ^ simhash.fingerprint(one.encode())).bit_count() <= 3
    )
    rows = [(None, near), (7, one), (7, near), (None, two), (None, two), (8, "")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 0), (0, 7), (7, 7), (7, 7), (8, 8)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in kept) == {7: 1, None: 1, 8: 1}


def test_stages_keep_columns_of_any_name_and_type(spark):
    from conftest import prose

    names = "_text _key _mark _runs _id _source _chosen _column_3 row gram"
    rows = [(i, prose(120, i % 3), "en", "a", *("x" * 10), {"a": i}) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names.split()) + ", more map<string,int>"
    docs = spark.createDataFrame(rows, schema)
    from lodgetier.llm import mixing

    for stage, n in ((simhash.keep_one_of_each, 3), (suffix.without_repeats, 6), (mixing.mixed_documents, None)):
        out = stage(docs)
        assert out.columns == docs.columns and out.schema["more"].dataType == docs.schema["more"].dataType
        held = out.collect()
        assert (n is None or len(held) == n) and all(r._text == "x" and r.more == {"a": r.doc_id} for r in held)


def plain_repeats(rows, length):
    """Counts every string of the given length."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_table(odd, clashing):
    for docs in (odd, clashing):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, suffix.repeats_table(docs).collect()), key=repr) == plain_repeats(rows, 400)


@pytest.mark.parametrize("length, together", [(40, 1_024), (41, 2)])
def test_repeats_of_shared_passages(spark, length, together):
    pick = random.Random(3)
    passages = ["".join(pick.choice("abcdé ") for _ in range(pick.randrange(30, 120))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = ["".join(pick.choice("wxyzö ") for _ in range(pick.randrange(90))) for _ in range(4)]
        parts.insert(pick.randrange(4), pick.choice(passages))
        parts.insert(pick.randrange(4), pick.choice(passages)[pick.randrange(20) :])
        rows.append((i, "".join(parts) + "ha" * pick.randrange(60) * (i % 5 == 0)))
    docs = suffix._keyed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2))
    texts = {i: t.encode() for i, t in rows}
    covered = {i: np.zeros(len(t), bool) for i, t in texts.items()}
    for r in suffix.repeated_spans(docs, length, together).collect():
        covered[r.key][r.first : r.last + length] = True
    expected = {i: n for i, _, n, _, _ in plain_repeats(rows, length)}
    assert {i: int(c.sum()) for i, c in covered.items()} == expected


def test_repeats_of_hot_grams(spark):
    """One passage in a third of the rows, alone in most, inside longer shared and unshared text in others."""
    pick = random.Random(9)
    word = lambda n: "".join(pick.choice("abcdefgh ") for _ in range(n))
    hot, longer = word(300), word(200)
    rows = [(i, hot if i % 2 else word(30) + hot + word(40)) for i in range(60)]
    rows += [(100 + i, word(20) + hot + longer + word(50)) for i in range(10)] + [(200 + i, word(400)) for i in range(120)]
    rows += [(400, None), (401, hot[:249]), (402, hot + hot)]
    found = suffix.repeats_table(spark.createDataFrame(rows, "doc_id long, text string"), 250, with_text=True).collect()
    assert sorted((tuple(r[:5]) for r in found), key=repr) == plain_repeats(rows, 250)
    texts = {r.doc_id: r.text for r in found}
    assert texts[400] == "" and texts[1] == "" and texts[402] == "" and texts[401] == hot[:249]


def test_windows_name_the_same_anchors_in_any_pieces(monkeypatch):
    text = "".join(random.Random(1).choice("abc ") for _ in range(3_000)).encode() + b"ha" * 200
    named = []
    for piece in (1 << 20, 97):
        monkeypatch.setattr(suffix, "PIECE", piece)
        found = {}
        for _, move, data in suffix._pieces([text], 40):
            at, first, last, gram, _ = suffix.anchors(np.frombuffer(data, np.uint8), np.array([len(data)]), 40)
            for x, low, high, g in zip(at.tolist(), first.tolist(), last.tolist(), gram.tolist()):
                for window in range(low, high + 1):
                    assert window + move not in found
                    found[window + move] = (x + move, g)
        named.append(found)
    assert named[0] == named[1] and len(named[0]) == len(text) - 39


def test_without_repeats_keeps_rows_and_columns(odd, clashing):
    left = suffix.without_repeats(clashing)
    assert left.columns == clashing.columns and left.count() == odd.count()
    texts = {r.doc_id: r.text for r in left.collect() if r.doc_id}
    assert texts[5] == "" and texts[10] != "" and texts[1] is None


def test_empty_tables(none):
    for table in (bpe.bpe_table, packing.ids_table, simhash.near_duplicate_table, suffix.repeats_table, simhash.keep_one_of_each, suffix.without_repeats):
        assert table(none).count() == 0
