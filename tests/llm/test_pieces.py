import random

import sentencepiece
from pyspark.sql import functions as F

from factloom.llm import pieces
from factloom.llm.catalog import PIECES


def test_equals_merging_on_random_texts():
    model = pieces.model_bytes(PIECES)
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Vocabulary.of(model)
    rng, alphabet = random.Random(1), "abcdefghij é▁ \n\t.,!0123ABCéü漢字🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    known = list(ours.ids)
    texts += ["".join(rng.choice(known).replace("▁", " ") for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["", " ", "   a", "x" * 3000, " " * 200, "a" + " " * 37 + "b", "<s> </s>"]
    ids = ours.encode([theirs.normalize(t) if t else "" for t in texts])
    assert [list(i) for i in ids] == theirs.encode(texts)
    assert [ours.decode(i, True) for i in ids] == theirs.decode([list(map(int, i)) for i in ids])


def test_unigram_scores_take_the_best_path():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.0, "ab": -3.5, "▁a": -2.5, "bb": -9.0, "abb": -5.0}
    v = pieces.Vocabulary(scores, {p: i for i, p in enumerate(scores)}, 99, [], [p.encode() for p in scores], merges=False)

    def every(word):
        if not word:
            yield 0.0, []
        for n in range(1, len(word) + 1):
            head = word[:n]
            if head in scores or n == 1:
                for s, rest in every(word[n:]):
                    yield scores.get(head, v.lowest) + s, [head, *rest]

    for word in ("▁abb", "▁ab", "▁ba", "▁aab", "▁abab", "▁azb", "abba"):
        want = max(every(word))[1]
        assert v.encode([word])[0].tolist() == [v.ids.get(p, 99) for p in want]


def test_small_caches_change_nothing(monkeypatch):
    model = pieces.model_bytes(PIECES)
    text = ["▁the▁quick▁brown▁fox", "▁jumps▁over▁the▁lazy▁dog"]
    want = [i.tolist() for i in pieces.Vocabulary.of(model).encode(text)]
    monkeypatch.setattr(pieces, "KEPT_WORDS", 1)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 1)
    v = pieces.Vocabulary.of(model)
    assert [v.encode([t])[0].tolist() for t in text] == want


def test_odd_rows(odd_docs, no_docs):
    rows = pieces.encode(odd_docs, PIECES, keep=("doc_id", "text", "score")).collect()
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.ids is None and r.n_ids == 0) if r.text is None else (r.ids == theirs.encode(r.text) and r.round_trip)
    assert pieces.encode(no_docs, PIECES).count() == 0


def test_decode(odd_docs):
    encoded = pieces.encode(odd_docs, PIECES, keep=("doc_id", "text"))
    back = pieces.decode(encoded.withColumnRenamed("text", "was"), PIECES, keep=("doc_id", "was"))
    assert back.filter(~F.col("text").eqNullSafe(F.col("was"))).count() == 0


def test_model_type_is_read_from_the_model():
    assert pieces.model_type(pieces.model_bytes(PIECES)) == pieces.BPE
    assert pieces.model_type(b"\x0a\x02ab\x12\x02\x18\x01") == pieces.UNIGRAM == pieces.model_type(b"")
    assert pieces.model_type(b"\x12\x0e\x0a\x05abcde\x18\x02\x25\x00\x00\x00\x00") == pieces.BPE
