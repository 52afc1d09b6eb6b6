import random

from factloom.llm import shingles, simhash
import corpus_pipeline


def plain_sets(texts, width=5):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    return sets


def plain_components(sets, percent=80):
    label = list(range(len(sets)))
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    return label


def edited(seed=3):
    rng, texts = random.Random(seed), []
    for n in (3, 6, 12, 30, 60, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randint(0, 9999)}" for _ in range(n)]
            for _ in range(6):
                words = list(base)
                for _ in range(rng.randint(0, max(1, n // 25))):
                    words[rng.randrange(n)] = f"w{rng.randint(0, 9999)}"
                texts.append(" ".join(words + [f"t{i}" for i in range(rng.randint(0, max(1, n // 10)))]))
    line = "all rights of this line of boilerplate are kept by all of us for ever"
    return texts + [f"{line} n{i} {' '.join(f'v{rng.randint(0, 9999)}' for _ in range(8))}" for i in range(30)] + ["The  CAT\tsat", "the cat sat", "", None, " \n", "solo"]


def test_links_equal_brute_force(spark, monkeypatch):
    texts = edited()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = plain_sets(texts)
    want = [i for i, c in enumerate(plain_components(sets)) if i == c]
    assert sorted(r.doc_id for r in shingles.first_of_each(docs).collect()) == want
    for name, value in (("SHARE", 1), ("LONG", 8), ("HELD", 10), ("SMALL", 0), ("BATCH", 50)):  # these change no result
        monkeypatch.setattr(shingles, name, value)
    assert len(shingles._common(shingles._marked(shingles._texts(docs), 5), 5, 80)) > 0
    assert sorted(r.doc_id for r in shingles.first_of_each(docs).collect()) == want


def test_stage_drops_edited_copies_that_fingerprints_keep(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    copy = [*base[:40], "changed", *base[41:80], "again", *base[81:]]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy))], "doc_id long, text string")
    assert simhash.first_of_each(docs).count() == 2
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]


def test_a_shared_line_makes_few_pairs(spark, monkeypatch):
    """20,000 short texts share a line of boilerplate, most under a number of pairs that grows with them, not with its square."""
    rng, line = random.Random(7), "all rights of this line of boilerplate are kept by all of us for ever"
    texts = [f"{line} n{i} {' '.join(f'v{rng.randint(0, 99_999)}' for _ in range(20))}" for i in range(20_000)] + [f"{line} n{i} same words as all the others of these few" for i in (1, 2)]
    asked, confirm = [], shingles._confirmed
    monkeypatch.setattr(shingles, "_confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirm(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert shingles.first_of_each(docs).count() >= 20_000
    assert sum(asked) <= 20_000


def test_odd_rows(odd_docs, no_docs):
    kept = shingles.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert sum(r.text == "one" for r in rows) == 1 and sum(not (r.text or "").strip() for r in rows) == 1
    assert shingles.first_of_each(no_docs).count() == 0


def test_prefixes_hold_the_rarest_members(spark):
    """Prefixes go by rising frequency over all sets: a line of all texts is in none, and of two lines the rarer one comes first."""
    rng, line = random.Random(5), "this line is a part of all the texts there are"
    texts = [f"{line} {' '.join(f'w{rng.randint(0, 999_999)}' for _ in range(100))}" for _ in range(40)]
    marked = shingles._marked(shingles._texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), 5)
    common = shingles._common(marked, 5, 80)
    shared = set(shingles.shingles(line).view("int64").tolist())
    found = {t for r in shingles._prefixes(marked, 5, 80, common, 3).collect() for t in r.tokens}
    assert found and not found & shared
    often, seldom = "six words that are used often", "six words that are seldom used"
    both = spark.createDataFrame([(i, f"{often} x{i}") for i in range(9)] + [(10 + i, f"{seldom} y{i}") for i in range(5)], "doc_id long, text string")
    order = shingles._common(shingles._marked(shingles._texts(both), 5), 5, 80).tolist()
    frequent, rarer = (set(shingles.shingles(t).tolist()) & set(order) for t in (often, seldom))
    assert frequent and rarer and max(map(order.index, rarer)) < min(map(order.index, frequent))
