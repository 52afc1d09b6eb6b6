import pandas as pd
import pyarrow as pa

from factloom.llm import pieces, quality_model, shingles, workers
from factloom.llm.catalog import PIECES


class Taken:
    """Stands for a DataFrame: hands out the function that Spark would run in its workers."""

    def mapInArrow(self, function, schema):
        return function


def test_stages_drop_what_the_encoder_left_in_a_worker():
    model = pieces.model_bytes(PIECES)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_hash": [1], "text": ["a b c d e f"]})
    for stage in (lambda: shingles._marked(Taken(), 5)(iter([batch])), lambda: quality_model._voted(iter([pd.DataFrame({"text": ["a b"]})]))):
        left = pieces._Worker.get(model)
        left.vocabulary.encode(["▁the▁quick"])
        assert pieces._Worker.get(model) is left and left.vocabulary.words
        assert list(stage()) and not workers._state


def test_a_worker_holds_one_state():
    made = []
    make = lambda name: lambda: made.append(name) or name
    assert [workers.kept(k, make(k)) for k in "aabba"] == list("aabba")
    assert made == list("aba") and list(workers._state) == ["a"]
    workers.forget()


def test_words_are_kept_packed():
    v = pieces.Vocabulary.of(pieces.model_bytes(PIECES))
    assert v.encode(["", "▁the▁the"])[0].tolist() == [] and all(type(ids) is bytes for ids in v.words.values())


def test_a_full_cache_keeps_the_words_that_came_again():
    v = pieces.Vocabulary.of(pieces.model_bytes(PIECES))
    v.room = 4
    for text in ("▁one▁two", "▁one▁three", "▁four▁five▁six", "▁one"):
        v.encode([text])
    assert "▁one" in v.words and "▁two" not in v.words and len(v.words) <= 4


def test_a_lean_worker_gives_the_same_ids(spark, monkeypatch):
    monkeypatch.setattr(pieces, "LEAN_WORDS", 3)
    docs = spark.createDataFrame([(i, f"word{i % 7} and the other {i} " * 3) for i in range(40)] + [(99, None)], "doc_id long, text string")
    lean, full = (sorted((r.doc_id, r.ids) for r in pieces.encode(docs, PIECES, lean=x).collect()) for x in (True, False))
    assert lean == full
