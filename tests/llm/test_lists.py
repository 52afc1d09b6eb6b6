import datetime
import textwrap

from factloom.llm import licenses, url_filters
from factloom.llm.licenses import KNOWN, MIT


def day(text):
    return datetime.date.fromisoformat(text)


LOG = [
    ("host", "a.example.com", "block", day("2024-02-01")), ("host", "a.example.com", None, day("2024-03-01")), ("host", "a.example.com", "block", day("2024-05-01")),
    ("domain", "example.com", "block", day("2024-01-10")), ("prefix", "a.example.com/ok", "allow", day("2024-01-15")), ("domain", "other.org", "allow", day("2024-01-01")),
    ("domain", "other.org", "block", day("2024-01-01")), (None, "x", "block", day("2024-01-01")), ("host", None, "block", day("2024-01-01")), ("host", "b.c", "block", None),
]


def judged(spark, captures, log=LOG):
    entries = spark.createDataFrame(log, "kind string, pattern string, verdict string, on_date date")
    rows = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").selectExpr("*", "'k' as key", "'h' as host", "1 as rank")
    return {r.page_id: (r.verdict, r.decided_by, r.n_active) for r in url_filters.judge(rows, entries).collect()}


def test_entries_hold_as_of_the_fetch_date(spark):
    at = lambda i, url, d: (i, url, day(d) if d else None)
    got = judged(spark, [
        at(1, "http://a.example.com/x", "2024-01-05"), at(2, "http://a.example.com/x", "2024-01-10"), at(3, "https://A.Example.com:8080/x?q#f", "2024-02-01"),
        at(4, "http://a.example.com/x", "2024-03-01"), at(5, "http://a.example.com/x", "2024-06-01"), at(6, "http://user@a.example.com/ok/deep/", "2024-02-02"),
        at(7, "http://a.example.com/okay", "2024-02-02"), at(8, "//other.org", "2024-02-02"), at(9, None, "2024-02-02"), at(10, "nonsense", "2024-02-02"),
        at(11, "http://a.example.com/x", None), at(12, "http://notexample.com/", "2024-06-01"), at(None, "http://a.example.com/", "2024-06-01"), at(13, "http://b.c/" + "d/" * 300, "2024-06-01")])
    assert got == {
        1: ("none", None, 0), 2: ("block", "domain:example.com", 1), 3: ("block", "host:a.example.com", 2), 4: ("block", "domain:example.com", 1),
        5: ("block", "host:a.example.com", 2), 6: ("allow", "prefix:a.example.com/ok", 3), 7: ("block", "host:a.example.com", 2), 8: ("block", "domain:other.org", 1),
        9: ("none", None, 0), 10: ("none", None, 0), 11: ("none", None, 0), 12: ("none", None, 0), None: ("block", "host:a.example.com", 2), 13: ("none", None, 0)}


def test_empty_lists_and_tables(spark):
    assert judged(spark, [(1, "http://a.b/", day("2024-01-01"))], [])[1] == ("none", None, 0)
    assert judged(spark, []) == {}


def test_case_counts_in_paths_only(spark):
    log = [("prefix", "Example.com/Docs", "block", day("2024-01-01")), ("host", "B.Example.com", "allow", day("2024-01-01"))]
    got = judged(spark, [(i, u, day("2024-02-01")) for i, u in enumerate(
        ["http://example.com/Docs/x", "http://EXAMPLE.com/Docs", "http://example.com/docs/x", "http://b.example.com/Docs"])], log)
    assert got == {0: ("block", "prefix:example.com/Docs", 1), 1: ("block", "prefix:example.com/Docs", 1), 2: ("none", None, 0), 3: ("allow", "host:b.example.com", 1)}


def test_canonical_license_texts(spark):
    other = "The MIT Licence".replace("The ", "") + "\n\nCopyright (c) 2021-2024 Some Person\nAll rights reserved.\n\n" + MIT.upper().replace(", ", " , ").replace("SUBLICENSE", "SUBLICENCE")
    rows = [(1, other), (2, MIT + " And more."), (3, "intro\n  released under the MIT LICENSE!! \noutro"), (4, None), (5, ""), (6, "© 2020 me"), (7, "Licensed under CC BY-NC 4.0."),
            (None, MIT), (8, "Licensed under CC BY 4.0.\nx\nLicensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0."), (9, "x" * 100_000), (9, "twice"), (9, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as whole", "1 as page", "'d' as digest", "'l' as license_id")
    got = {r.doc_id: (r.whole_license, r.line_licenses) for r in licenses.scan(docs).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, "MIT"), 4: (None, ""), 5: (None, ""), 6: (None, ""), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0"),
                   None: ("MIT", ""), 8: (None, "Apache-2.0,CC-BY-4.0"), 9: (None, "")} | {None: got[None]}
    assert got[None][0] == "MIT"
    assert licenses.scan(docs.filter("false")).count() == 0


def test_every_known_text_is_found(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(KNOWN)], "doc_id long, text string")
    assert {r.doc_id: r.whole_license for r in licenses.scan(docs).collect()} == {i: k for i, (k, _) in enumerate(KNOWN)}


def test_own_list(spark):
    docs = spark.createDataFrame([(1, "House rules: be kind!")], "doc_id long, text string")
    known = spark.createDataFrame([("HOUSE", "house rules; be kind"), ("EMPTY", "..."), (None, "x")], "license_id string, text string")
    assert licenses.scan(docs, known).first().whole_license == "HOUSE"


def test_whole_license_files_are_found(spark):
    wanted = {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"}
    texts = [(f.stem.split("--")[0], f.read_text()) for f in sorted(licenses.FOLDER.glob("*.txt"))]
    assert wanted <= {i for i, _ in texts}
    rows = []
    for name, text in texts:
        wrapped = "\n\n".join(p if "opyright (" in p or "opyright [" in p or "©" in p else textwrap.fill(p, 60, break_on_hyphens=False, break_long_words=False) for p in text.split("\n\n"))
        rows += [(name, text), (name, "Copyright (c) 2024 Some Person\n\n" + wrapped), (None, text + "\nAnd one more term.")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.whole_license for r in licenses.scan(docs).collect()}
    assert [(i, n, got[i]) for i, (n, _) in enumerate(rows) if got[i] != n] == []
