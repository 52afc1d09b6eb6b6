"""Similarity joins, clusters and components against brute force."""

import random
from difflib import SequenceMatcher

import pytest

from factloom.functions.similarity import _lcs
from factloom.operators import merging as M
from factloom.operators.common import contained_in
from factloom.operators.components import connected_components
from factloom.operators.simjoin import containment_pairs, lcs_pairs, lcs_pairs_apart, lcs_stars, ratio_pairs


def _names(seed=7, n=160):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefg青岛涂料集团") for _ in range(rng.randint(3, 14))) for _ in range(n // 4)]
    out = set(base)
    for name in base:
        for _ in range(3):
            chars = list(name)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(chars))
                if rng.random() < 0.4 and len(chars) > 2:
                    del chars[i]
                else:
                    chars.insert(i, rng.choice("abcdefg青岛涂料"))
            out.add("".join(chars))
    return sorted(out)


def _lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_lcs_bits_equal_table():
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        assert _lcs(a, b) == _lcs_table(a, b)


def test_ratio_join_misses_nothing(spark):
    names = _names()
    df = spark.createDataFrame([(n, n) for n in names], "id string, name string")
    got = {(r["a"], r["b"]) for r in ratio_pairs(df, 0.82).collect()}
    want = set()
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.82:
                want.add((a, b))
    assert len(want) > 50
    assert want <= got, sorted(want - got)[:5]


def test_lcs_join_misses_nothing(spark):
    names = _names(11)
    df = spark.createDataFrame([(n, n) for n in names], "id string, name string")
    got = {(r["a"], r["b"]) for r in lcs_pairs(df, 0.68).collect()}
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if _lcs(a, b) / max(len(a), len(b)) >= 0.68}
    assert len(want) > 100
    assert want <= got, sorted(want - got)[:5]


def test_containment_join_is_exact(spark):
    names = _names(3) + ["ab", "a"]
    df = spark.createDataFrame([(n, n) for n in sorted(set(names))], "id string, name string")
    got = {(r["a"], r["b"]) for r in containment_pairs(df, 0.7).collect()}
    names = sorted(set(names))
    score = lambda a, b: 0.5 + 0.45 * min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0
    assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1:] if score(a, b) >= 0.7}


@pytest.mark.parametrize("hot", [50_000, 3])
@pytest.mark.parametrize("min_len", [1, 2])
def test_containment_by_rarest_gram_matches_brute_force(spark, hot, min_len):
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("ab青岛c") for _ in range(rng.randint(0, most)))
    names, texts = [word(9) for _ in range(100)], [word(40) for _ in range(150)]
    # very long, periodic, repeated, empty and missing texts
    texts += ["x" * 70 + names[0], "ab" * 2500, None, "", names[5], names[5]]
    names += ["x" * 66, "ab" * 2500, "a", "ab", None, "", names[5]]
    short = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    long = spark.createDataFrame(list(enumerate(texts)), "j int, t string")
    got = sorted((r["i"], r["j"]) for r in contained_in(short, long, "n", "t", min_len, hot).collect())
    assert got == sorted((i, j) for i, n in enumerate(names) for j, t in enumerate(texts)
                         if n and t and len(n) >= min_len and n in t)


def test_containment_of_empty_tables(spark):
    short = spark.createDataFrame([(1, "ab")], "i int, n string")
    long = spark.createDataFrame([(1, "xabx")], "j int, t string")
    assert contained_in(short.limit(0), long, "n", "t").count() == 0
    assert contained_in(short, long.limit(0), "n", "t").count() == 0


def test_names_of_many_lengths_in_one_long_text(spark):
    text = "".join(chr(0x4E00 + i) for i in range(5000))
    names = [text[k:k + n] for n in range(40, 4000, 90) for k in (0, 7)]
    short = spark.createDataFrame([(n,) for n in names], "n string")
    long = spark.createDataFrame([(text,), (text[::-1],)], "t string")
    met = contained_in(short, long, "n", "t").collect()
    assert sorted(r["n"] for r in met) == sorted(names) and {r["t"] for r in met} == {text}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("h000", f"h{i:03d}") for i in range(1, 80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {n: find(n) for n in list(root)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == want


def test_clusters_respect_places_and_match_brute_force(spark):
    texts = [("佐敦涂料", 5, "e1"), ("佐敦涂料（青岛）", 3, None), ("佐敦涂料（上海）", 9, None), ("佐敦涂料公司", 2, None),
             ("中远海运", 1, None), ("中远海运集团", 4, None), ("孤立名称", 8, None)]
    rows = [(t, c, e, None, "entity" if e else "subject_text") for t, c, e in texts]
    items = spark.createDataFrame(rows, "text string, fact_count bigint, entity_id string, entity_type string, source string")
    out = M.cluster_names(items).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["pivot"], set()).add(r["text"])
    assert groups == {
        "佐敦涂料": {"佐敦涂料", "佐敦涂料（青岛）", "佐敦涂料（上海）", "佐敦涂料公司"}, "中远海运集团": {"中远海运", "中远海运集团"}}
    assert all(r["place_warning"] == (r["pivot"] == "佐敦涂料") for r in out)


@pytest.mark.parametrize("seed", [2, 13])
def test_clusters_of_odd_names_match_brute_force(spark, seed):
    rng = random.Random(seed)
    places = ["", "", "（青岛）", "(上海)", "（香港）"]
    texts = sorted({n + rng.choice(places) for n in _names(seed, 120)} | {f"Supplier#{i:09d}{p}" for i in range(40) for p in ("（青岛）", "（上海）")}
                   | {"青岛", "（青岛）青岛", "a", "ab", "x" * 70, "x" * 60 + "y" * 20, "集 团", "集团"})
    items = spark.createDataFrame([(t, i % 7, None, None, "subject_text") for i, t in enumerate(texts)],
                                  "text string, fact_count bigint, entity_id string, entity_type string, source string")
    rows = [tuple(r) for r in items.select("text", M.cluster_key(items.text), M.cluster_place(items.text)).collect()]
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, ka, pa) in enumerate(rows):
        for b, kb, pb in rows[i + 1:]:
            long, short = max(len(ka), len(kb)), min(len(ka), len(kb))
            held = short / long * 0.45 + 0.5 if ka in kb or kb in ka else 0
            if not (pa and pb and pa != pb) and (ka == kb or max(held, _lcs(ka, kb) / long) >= 0.68):
                root[find(b)] = find(a)
    want = {}
    for t in texts:
        want.setdefault(find(t), set()).add(t)
    got = {}
    for r in M.cluster_names(items).collect():
        got.setdefault(r["pivot"], set()).add(r["text"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    assert len(got) > 10


def test_alike_names_are_not_paired_with_each_other(spark):
    names = [(i, f"supplier#{i:09d}", None) for i in range(600)] + [(1000, "supplier#x", None), (1001, "supplier#xy", None)]
    nodes = spark.createDataFrame(names, "id long, t string, place string")
    stars = lcs_stars(nodes, 0.68)
    assert stars.count() < 30 * len(names)
    assert all(_lcs(dict((i, t) for i, t, _ in names)[r.a], dict((i, t) for i, t, _ in names)[r.b]) >= 12 or r.a >= 1000 for r in stars.limit(200).collect())
    apart = nodes.withColumn("c", (nodes.id >= 1000).cast("long"))
    assert lcs_pairs_apart(apart, 0.68).count() == 0
    assert [tuple(r) for r in lcs_pairs_apart(nodes.filter("id >= 999 or id < 1").withColumn("c", nodes.id), 0.68).collect()] == [(1000, 1001)]


def test_merge_suggestions_rules(spark):
    rows = [("1", "佐敦涂料（青岛）有限公司", "企业"), ("2", "佐敦涂料（上海）有限公司", "企业"), ("3", "佐敦涂料", "企业"),
            ("4", "中国上榜品牌", "集团"), ("5", "美国上榜品牌", "集团"), ("6", "国际油漆股份公司", "企业"), ("7", "国际油漆股份有限公司", "企业")]
    out = M.merge_suggestions(spark.createDataFrame(rows, "entity_id string, canonical_name string, entity_type string"))
    got = {(r["primary_id"], r["secondary_id"]) for r in out.collect()}
    pairs = {frozenset(p) for p in got}
    assert frozenset("12") not in pairs and frozenset("45") not in pairs
    assert frozenset("67") in pairs


def test_copies_of_a_name_make_one_suggestion_each(spark):
    rows = [(f"a{i:02}", "佐敦涂料", "企业") for i in range(30)] + [(f"b{i:02}", "佐敦涂料公司", "品牌") for i in range(30)] + [("c", "海虹老人", "企业")]
    names = spark.createDataFrame(rows, "entity_id string, canonical_name string, entity_type string")
    every = M.merge_suggestions(names, limit=None).collect()
    few = M.merge_suggestions(names, limit=None, expand=False).collect()
    assert len(every) == 60 * 59 // 2 and len(few) == 29 + 29 + 1
    assert {tuple(r) for r in few} <= {tuple(r) for r in every}
    between = lambda out: {(r.primary_name, r.secondary_name, r.score) for r in out if r.primary_name != r.secondary_name}
    assert between(few) == between(every) and len(between(few)) == 1
