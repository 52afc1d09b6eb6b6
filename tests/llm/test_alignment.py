"""Token alignment against plain versions that use the tokenizer libraries themselves."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from factloom.llm import catalog, token_alignment
from factloom.llm.tables import table
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(catalog.BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=catalog.PIECES)


def plain(texts, a, b):
    """Expected columns but doc_id, of one text at a time, from offset to offset."""
    letters, raw_a = token_alignment._alphabet(), {i: t for t, i in a.get_vocab().items()}
    found = []
    for text in texts:
        want = (" " + (text or "")).encode()
        of_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        of_b = b.encode(text) if text else []
        by_a = [bytes(letters[c] for c in raw_a[i]) for i in of_a]
        by_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in of_b]
        if b"".join(by_a) != want or b"".join(by_b) != want:
            of_a, of_b, by_a, by_b = [], [], [], []
        end, ends_a, ends_b = 0, [], []
        for ends, parts in ((ends_a, by_a), (ends_b, by_b)):
            end = 0
            for part in parts:
                end += len(part)
                ends.append(end)
        groups, pairs, start = [], [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            one = [i for i, e in zip(of_a, ends_a) if start < e <= cut]
            other = [i for i, e in zip(of_b, ends_b) if start < e <= cut]
            groups.append(",".join(map(str, one)) + "|" + ",".join(map(str, other)))
            pairs.append((one[-1], other[-1]))
            start = cut
        found.append((len(of_a), len(of_b), groups, pairs))
    counts = Counter(p for *_, pairs in found for p in pairs)
    best = {}
    for (_, of_b), n in counts.items():
        best[of_b] = max(best.get(of_b, 0), n)
    return [(n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
            for n_a, n_b, groups, pairs in found]


def key(row):
    return tuple((v is None, v) for v in row)


def test_whole_table_against_plain(spark, tokenizers):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    short = [d for d in docs if len(d.text or "") < 3000]
    result = token_alignment.align(spark.createDataFrame(short, "doc_id long, text string"), catalog.BYTES, catalog.PIECES, groups=False)
    assert result.columns == COLUMNS
    expected = [(d.doc_id, *r) for d, r in zip(short, plain([d.text for d in short], *tokenizers))]
    assert sorted(map(tuple, result.collect()), key=key) == sorted(expected, key=key)


def test_blocks_do_not_change_the_result(spark, tokenizers, monkeypatch):
    docs = table(spark, SF, "documents")
    whole = sorted(map(tuple, catalog.op11_alignment(spark, SF).collect()), key=key)
    monkeypatch.setattr(token_alignment, "BLOCK", 20_000)
    monkeypatch.setattr(token_alignment, "PAIRS", 100)
    parts = token_alignment.align(docs.repartition(5), catalog.BYTES, catalog.PIECES, groups=False)
    assert sorted(map(tuple, parts.collect()), key=key) == whole


def test_odd_rows(spark, odd_docs, no_docs, tokenizers):
    texts = odd_docs.select("doc_id", "text").collect()
    slow = [t if len(t or "") < 8_000 else None for t in (r.text for r in texts)]
    texts = [(r.doc_id, t) for r, t in zip(texts, slow)] + [(90, "a ▁ mark"), (91, "<|endoftext|> <s> <unk> <0x41>"), (92, "  nbﬁ   é")]
    result = token_alignment.align(spark.createDataFrame(texts, "doc_id long, text string"), catalog.BYTES, catalog.PIECES)
    expected = [(i, *r) for (i, _), r in zip(texts, plain([t for _, t in texts], *tokenizers))]
    assert sorted(map(tuple, result.select(*COLUMNS).collect()), key=key) == sorted(expected, key=key)
    by_id = {r.doc_id: r for r in result.collect()}
    assert by_id[90].n_a == 0 and by_id[90].groups == "" and by_id[91].n_a > 8
    assert hashlib.sha256(by_id[91].groups.encode()).hexdigest() == by_id[91].groups_sha256
    assert token_alignment.align(odd_docs, catalog.BYTES, catalog.PIECES).count() == odd_docs.count()
    assert token_alignment.align(no_docs, catalog.BYTES, catalog.PIECES).count() == 0


def test_tokens_without_bytes_link_all_that_end_together():
    ends_a, ends_b = [2, 2, 5], [1, 2, 2, 5, 5]
    assert token_alignment.cuts(ends_a, ends_b) == [(2, 3), (3, 5)]
    groups, linked = token_alignment.groups_and_links([10, 11, 12], [20, 21, 22, 23, 24], ends_a, ends_b)
    assert groups == ["10,11|20,21,22", "12|23,24"]
    assert sorted(linked) == [(10, 21), (10, 22), (11, 21), (11, 22), (12, 23), (12, 24)]


def test_out_of_order_merges_are_refused():
    model = '{"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": [["a", "b"], ["b", "a"]]}}'
    with pytest.raises(ValueError):
        token_alignment.byte_tokenizer(model)


def test_cut_words_give_whole_texts(tokenizers):
    """Encoding word by word gives what the libraries give for whole texts, whatever white space stands between."""
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\t", "\n ", " \n", " ", "\u0085", "\x1c", "　", "a", "the", "It's", "12", "!", "é", "漢", "🙂", "​", "x" * 30]
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(3000)]
    (a, raw_a), (b, raw_b) = token_alignment.byte_tokenizer(open(catalog.BYTES).read()), token_alignment.piece_tokenizer(open(catalog.PIECES, "rb").read())
    block = token_alignment.Block(a, b, raw_a, raw_b)
    for text, row, expected in zip(texts, block.rows(texts), plain(texts, *tokenizers)):
        assert (*row[:4], hashlib.sha256(row[4].encode()).hexdigest() if row[0] else "") == (*expected[:4], expected[6]), repr(text)
    assert not token_alignment.crosses(raw_b) and token_alignment.crosses([b"of the"])
