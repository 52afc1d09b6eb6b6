import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import langid, quality_model

SF = "/root/testdata/sf0.01"


def test_backpropagation_equals_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.new(["a", "b", "c"], 4, rng)
    for cell in (net.ahead, net.behind):
        cell.table, cell.state = cell.table.astype(float), cell.state.astype(float)
    net.out = net.out.astype(float)
    x, y = rng.integers(0, 5, (7, 6)).astype(np.uint8), rng.integers(0, 3, 6)
    grads, _ = net.gradients(x, y)
    for part, grad in zip(net.parts(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, min(n, 5)) for n in part.shape)
            was, sides = part[at], []
            for d in (1e-5, -1e-5):
                part[at] = was + d
                sides.append(net.gradients(x, y)[1])
            part[at] = was
            assert abs((sides[0] - sides[1]) / 2e-5 - grad[at]) < 1e-5


def test_pooling_equals_a_walk_over_positions():
    net = langid.Network.new(["a", "b"], 4, np.random.default_rng(1))
    texts = ["abc é" * 40, "", "z"]
    got = langid.label(net, texts)
    for text, row in zip(texts, got):
        raw, total = text.encode(), np.zeros(2)
        for start in range(0, len(raw), langid.STEPS):
            part = np.frombuffer(raw[start:start + langid.STEPS], np.uint8)[:, None]
            ahead, behind = net.states(part)
            total += sum(net.position(a[0], b[0])[:, 0] for a, b in zip(ahead, behind))
        assert np.allclose(row, total / max(len(raw), 1), atol=1e-5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out_documents(docs):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    asked = rows[rows.held_out & (rows.lang_pred != "und")]
    assert len(asked) > 100 and (asked.lang == asked.lang_pred).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_language_odd_rows(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (0, 1, 2, 11):  # null, empty, blank, digits only
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in rows} <= {"und", "en", "de"}
    assert langid.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_quality_against_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_model.classify(docs).join(labels, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.keep.mean() > 0.99 and bad.keep.mean() < 0.06


def test_estimates_follow_planted_accuracies():
    rng = np.random.default_rng(2)
    kinds = rng.choice(4, 4000, p=[0.7, 0.1, 0.1, 0.1])
    votes = np.where(rng.random((4000, 3)) < 0.02, -1, 1)
    for k in range(3):
        votes[(kinds == k + 1) & (rng.random(4000) < 0.9), k] = -1
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, chance, share = quality_model.estimate(patterns, counts.astype(float))
    label = {tuple(p): g for p, g in zip(patterns, good)}
    guess = np.array([label[tuple(v)] for v in votes]) > 0.5
    seen = (votes == -1).any(axis=1)
    assert (guess == (kinds == 0))[seen | (kinds == 0)].mean() > 0.94
    assert (chance[0, :, 0] < 0.06).all() and (chance[[1, 2, 3], [0, 1, 2], 0] > 0.7).all()


def test_quality_odd_rows(odd_docs, no_docs):
    rows = quality_model.classify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.score == 0 and not r.keep for r in rows if r.doc_id in (0, 1, 2))
    kept = quality_model.good_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.keep for r in rows)
    assert quality_model.classify(no_docs).count() == 0 and quality_model.good_documents(no_docs).count() == 0


FURTHER = {
    "ru": "Вчера вечером мы долго гуляли вдоль реки и говорили о новой книге. Потом пошёл дождь, и пришлось вернуться домой раньше обычного. Утром город был тихим и почти пустым.",
    "pl": "Wczoraj wieczorem długo spacerowaliśmy wzdłuż rzeki i rozmawialiśmy o nowej książce. Potem zaczął padać deszcz, więc wróciliśmy wcześniej niż zwykle. Rano miasto było ciche i prawie puste.",
    "tr": "Dün akşam nehir boyunca uzun süre yürüdük ve yeni kitap hakkında konuştuk. Sonra yağmur başladı, bu yüzden eve her zamankinden erken döndük. Sabah şehir sessiz ve neredeyse boştu.",
    "el": "Χθες το βράδυ περπατήσαμε πολλή ώρα δίπλα στο ποτάμι και μιλήσαμε για το νέο βιβλίο. Μετά άρχισε να βρέχει και γυρίσαμε νωρίτερα στο σπίτι. Το πρωί η πόλη ήταν ήσυχη και σχεδόν άδεια.",
    "ar": "مشينا مساء أمس طويلا على ضفة النهر وتحدثنا عن الكتاب الجديد. ثم بدأ المطر فعدنا إلى البيت أبكر من المعتاد. وفي الصباح كانت المدينة هادئة وشبه خالية من الناس.",
    "hi": "कल शाम हम नदी के किनारे बहुत देर तक टहले और नई किताब के बारे में बात की। फिर बारिश शुरू हो गई और हम जल्दी घर लौट आए। सुबह शहर शांत और लगभग खाली था।",
}


def test_clean_texts_of_further_languages_are_kept(docs):
    rng = np.random.default_rng(4)
    rows = []
    for i, (lang, text) in enumerate(FURTHER.items()):
        parts = text.replace("।", "।.").replace(".", ".|").split("|")[:-1]
        for j in range(20):
            rows.append((10**9 + 100 * i + j, lang, " ".join(parts[k].strip().replace("।.", "।") for k in rng.permutation(len(parts)).tolist() * 2)))
    at = quality_model.LABELLERS.index("function_words")
    assert all(quality_model.votes(t)[at] != quality_model.BAD for _, _, t in rows)
    both = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string"))
    kept = {r.doc_id for r in quality_model.classify(both).filter("keep").collect()}
    assert [(i, lang) for i, lang, _ in rows if i not in kept] == []
    assert quality_model.votes("qq%%% 12 zx&&& 7 | 9 " * 10)[at] == quality_model.BAD


def test_only_letters_make_a_language():
    from factloom.llm.langid import has_letter
    assert not any(map(has_letter, ("", "½ ² 12 _", "!?", "٣", "Ⅷ"))) and all(map(has_letter, ("½a", "é", "ا", "字", "ª")))


def test_sample_is_the_same_whatever_the_order(spark):
    rows = [(None if i % 3 else i, f"This is text number {i % 40}, and it is about the {'house' * (i % 5)} of the town.") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, _ = quality_model.fit(docs, sample=25)
    again, _ = quality_model.fit(docs.repartition(5), sample=25)
    assert (first == again).all()
