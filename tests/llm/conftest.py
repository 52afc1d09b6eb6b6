import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"

#: Texts that every operator on texts has to take: null, empty, blank, one word, repeated, very long, other scripts.
ODD_TEXTS = [
    None, "", " \n\t ", "one", "The Cat sat on the mat.", "the cat SAT on the mat.", "x" * 200_000, "word " * 30_000,
    "漢字 かな 🙂🙂", "é ü ñ ß", "a\u0000b", "1 " * 5_000, "  line\u0085sep", "ok\n" * 2_000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts under null, repeated and plain ids and sources, beside columns whose names clash with working columns."""
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one", "en", "s0"), (3, "another text", None, "s0"), (None, "no id", "de", None), (None, None, None, None)]
    extra = [(*r, len(r[1] or ""), 1.0, "x", 2, "y", 3) for r in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, score double, rank string, first long, _text string, size long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def duck():
    def run(sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(name, frame)
        return con.execute(sql).df()

    return run
