import random

import numpy as np
import xxhash

from factloom.llm import simhash


def plain_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, prints, radius=2):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def near_copies(seed=5, families=6, size=12):
    rng, texts = random.Random(seed), []
    for _ in range(families):
        base = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(400)] = f"w{rng.randint(0, 9999)}"
            texts.append(" ".join(words))
    return texts + ["The  CAT\tsat", "the cat sat", "", None, "solo"]


def test_fingerprints_and_components(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    want = components(range(len(texts)), prints)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert 1 < len(set(want)) < len(texts) - 10  # families are found, and not all in one
    kept = sorted(r.doc_id for r in simhash.first_of_each(docs).collect())
    assert kept == sorted(set(want))


def test_large_bucket_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(1)
    prints = {(1 << 63) | sum(1 << rng.randrange(20) for _ in range(rng.randint(0, 4))) for _ in range(300)}
    place = {p - (1 << 64) if p >> 63 else p: i for i, p in enumerate(sorted(prints))}
    rows = [(p,) for p in place]
    edges = [(place[a], place[b]) for a, b in simhash.links(spark.createDataFrame(rows, "print long"), 2).collect()]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert label == components(range(len(rows)), sorted(prints))


def test_bit_slices_equal_distances():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints[100:200] = prints[0] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    for radius in (0, 1, 2, 3, 5):
        near = np.bitwise_count(prints[:, None] ^ prints) <= radius
        want = {tuple(np.flatnonzero(r)) for r in near if r.sum() > 1}
        assert {tuple(x) for x in simhash.near_rows(prints, radius)} == want


def test_blocks_are_left_early():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 512, dtype=np.uint64)
    read = []
    assert not list(simhash.near_rows(prints, 2, read))  # random prints have no neighbours
    whole = 64 * 512 * 512 // 64
    assert sum(read) < whole / 2 and len(read) < 64 * 512 // simhash.QUERIES
    read.clear()
    list(simhash.near_rows(np.repeat(prints[:1], 512), 2, read))
    assert sum(read) == whole  # where all are neighbours nothing can be left


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_text = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    zero = "0" * 16
    assert by_text[0, zero] == by_text[1, zero] == by_text[2, zero] == by_text[None, zero] == 0
    assert by_text[4, f"{plain_fingerprint('the cat sat on the mat.'):016x}"] == by_text[5, f"{plain_fingerprint('the cat sat on the mat.'):016x}"] == 4
    kept = simhash.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sum(r.text == "one" for r in kept.collect()) == 1
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.first_of_each(no_docs).count() == 0
