import hashlib
import random
import re

import numpy as np
import pytest

from factloom.llm import pii
from factloom.llm.boosting import Boosted, cutoff

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    model, thresholds = pii.fit(spark)
    return {"model": model, "thresholds": thresholds}


def report(spark, texts, fitted):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in pii.report(docs, **fitted).collect()}
    return [rows[i] for i in range(len(texts))]


def test_base_equals_plain_search(spark, fitted):
    rng = random.Random(3)
    texts = ["", None, "a@b.co_x@d.e x@y..z é🙂 q@w.er.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 99999999999999999999.1.1.1 00000000255.0.0.1",
             "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (437) 555-0689 +12+345678901234567890 +1", "4111111111111111 12", "+" * 3000 + "1" * 3000,
             "1 " * 4000, "a.b" * 5000 + "@", "1.2." * 3000, "x@y.z " * 500]
    texts += ["".join(rng.choice("0123456789  ..--+@ab()é🙂%_:/[]") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    for text, row in zip(texts, report(spark, texts, fitted)):
        want = base_spans(text)
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s.startswith(k) for s in want) for k in PATTERNS]
        assert set(want) <= set(row.spans.split(",")) | {""}


def test_added_spans(spark, fitted):
    cases = {
        "write to anna [at] example [dot] org today": "email:9:36", "call (415) 555-2671 now": "phone:5:19", "mail sam at firma dot de, thanks": "email:5:24",
        "4111111111111111 12 left": "card:0:16", "pay with visa 4111.1111.1111.1111 today": "card:14:33", "login from 10[.]0[.]0[.]7 today": "ip:11:25",
    }
    clean = ["look at home.The river", "we met at noon dot by dot", "section 415-555-2671", "isbn 9783161484100", "at 12:34:56:78 it ended", "order 4111.1111.1111.1112",
             "The cat sat on the mat. It was 12.5 cm tall, 3-4 times.", "see chapter 1.2.3 of 2024-01-01"]
    got = report(spark, [*cases, *clean], fitted)
    for want, row in zip(cases.values(), got):
        assert want in row.spans.split(",")
    assert [r.spans for r in got[len(cases):]] == [""] * len(clean)


def test_redaction(spark, fitted):
    docs = spark.createDataFrame([(1, "mail a@b.co now 🙂 1.2.3.4", 5, "k"), (2, "clean", 5, "k"), (3, None, 0, "k"), (4, "+1 4111111111111111 x", 9, "k")], "doc_id long, text string, n_chars long, base string")
    got = {r.doc_id: (r.text, r.n_chars, r.base) for r in pii.redact(docs, **fitted).collect()}
    assert got[1] == ("mail [EMAIL] now 🙂 [IP]", 23, "k") and got[2] == ("clean", 5, "k") and got[3] == (None, 0, "k")
    assert "4111" not in got[4][0]


def test_odd_rows(odd_docs, no_docs, fitted):
    assert pii.report(odd_docs, **fitted).count() == odd_docs.count()
    redacted = pii.redact(odd_docs, **fitted)
    assert redacted.columns == odd_docs.columns
    assert sorted(map(str, redacted.collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.report(no_docs, **fitted).count() == 0 and pii.redact(no_docs, **fitted).count() == 0


def test_no_python_and_no_shuffle_in_the_plan(odd_docs, fitted):
    plan = pii.report(odd_docs, **fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan and "InPandas" not in plan


def test_running_sums(spark):
    rows = [[], [3], [1, 2, 3], list(range(1000))]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<bigint>").select("i", pii.running_sums(pii.F.col("x")).alias("s")).collect()
    for r in got:
        assert r.s == [sum(rows[r.i][:k]) for k in range(len(rows[r.i]))]


def test_boosting_learns_an_interaction(spark):
    x = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(2)] * 5)
    y = ((x[:, 0] > 1) ^ (x[:, 1] > 2)).astype(float)
    model = Boosted.fit(x, y, rounds=20)
    p = model.predict(x)
    assert ((p > 0.5) == (y > 0)).all() and cutoff(p, y, 1.0) <= p[y > 0].min() and cutoff(p, 1 - y, 1.0) > 1
    rows = spark.createDataFrame([tuple(map(int, r)) for r in x[:32]], "a int, b int, c int")
    got = [r.p for r in rows.select(model.column([pii.F.col(c) for c in "abc"]).alias("p")).collect()]
    assert np.allclose(got, p[:32])
