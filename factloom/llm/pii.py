"""Personal data in texts: exact base patterns, and more spans chosen by boosted trees.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Beside them, loose
generators of high recall propose further, overlapping spans: obfuscated addresses,
colon or bracketed IPs, cards with odd separators, phone numbers without a plus sign. Boosted trees
judge each proposal by format and context features; per-kind thresholds, calibrated on
held-out examples for precision, select what is added.

All work on documents is done by column expressions inside the row: no shuffle, no Python. Patterns
run in time linear in the text (possessive, and never restarted inside a run).
The trees are fitted on a few hundred labelled template sentences, whose features
come from the same expressions.
"""

from __future__ import annotations

import json
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import running_sums
from factloom.llm.boosting import Boosted, cutoff

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Their first and possessive parts only keep the search linear; the leftmost matches are unchanged.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Loose generators; what they propose is judged, never taken as such.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:[\x20]?@[\x20]?|[\x20]?[(\[{]at[)\]}][\x20]?|[\x20]at[\x20])[A-Za-z0-9-]++"
             r"(?:(?:\.|[\x20]?[(\[{](?:dot|\.)[)\]}][\x20]?|[\x20]dot[\x20])[A-Za-z0-9-]{2,24}+)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+(?![:0-9A-Fa-f])|[0-9]{1,3}+(?:[\x20]?[(\[{]\.[)\]}][\x20]?[0-9]{1,3}+){3}(?![0-9]))",
    "card": r"(?<![0-9])[0-9]{4}[\x20._/-]{0,2}(?:[0-9]{4}[\x20._/-]{0,2}[0-9]{4}[\x20._/-]{0,2}[0-9]{1,7}+|[0-9]{6}[\x20._/-]{0,2}[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+.(])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
}
#: A cheap test that must hold for a pattern to match at all.
NEEDS = {"email": "@", "phone": r"\+[0-9]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]"}
#: Words before a span that speak for and against a kind.
FOR = {
    "email": r"\b(?:e-?mail|mail|contact|write|reach|courriel|correo|adresse)\b", "ip": r"\b(?:ip|ipv6|ipv4|host|server|address|addr|login)\b",
    "card": r"\b(?:card|visa|mastercard|amex|payment|pay|karte|carte|tarjeta)\b", "phone": r"\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|appel)\b",
}
AGAINST = r"\b(?:version|order|isbn|invoice|ref|serial|tracking|section|page|date|build|mac|size|total|ratio|lot|sku|article)\b"
TOP_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz|co|ch|at|it|nl|us|ca|dev|app"
CONTEXT = 32
FEATURES = ("kind", "digits", "luhn", "symbols", "largest", "length", "cue", "counter_cue", "glued", "style", "domain")
#: Labelled sentences per template, share of right answers asked of added spans, and rounds of boosting.
EXAMPLES, PRECISION, ROUNDS = 24, 0.98, 24


def _matches(rows: DataFrame, text: str, pattern: str, name: str, guard: Column) -> DataFrame:
    """Add ``name``: array of (start, end, value) of the leftmost non-overlapping matches, in code points, end exclusive."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    rows = rows.withColumn("_m", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    some = F.size("_m") > 0
    rows = rows.withColumn("_g", F.when(some, F.transform(F.slice(F.split(text, pattern, -1), 1, F.size("_m")), F.char_length)))
    rows = rows.withColumn("_l", F.when(some, F.transform("_m", F.char_length)))
    rows = rows.withColumn("_s", F.when(some, running_sums(F.zip_with("_g", "_l", lambda g, m: g + m))))
    placed = F.transform(F.arrays_zip("_m", "_g", "_l", "_s"), lambda z: F.struct(
        (z["_s"] + z["_g"]).alias("start"), (z["_s"] + z["_g"] + z["_l"]).alias("end"), z["_m"].alias("value")))
    return rows.withColumn(name, F.when(some, placed).otherwise(none)).drop("_m", "_g", "_l", "_s")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of card numbers over a text of digits."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    values = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, (d * 2) % 10 + F.floor(d / 5).cast("int")).otherwise(d))
    return F.aggregate(values, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _features(text: Column, kind: str, span: Column) -> list[Column]:
    """Small integers of one proposal, in the order of FEATURES."""
    value, size = F.lower(span["value"]), F.char_length(span["value"])
    before = F.lower(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(CONTEXT)).cast("int")))
    after = F.substring(text, span["end"].cast("int") + 1, F.lit(1))
    digits = _digits(value)
    n = F.length(digits)
    yes = lambda c: F.when(c, 1).otherwise(0)
    symbols = F.size(F.array_distinct(F.split(F.regexp_replace(value, "[a-z0-9]", ""), "")))
    parts = F.transform(F.filter(F.split(value, "[^0-9]+"), lambda p: p != ""), lambda p: F.coalesce(p.try_cast("int"), F.lit(9999)))
    style = F.when(value.contains("@"), 3).when(value.rlike(r"[(\[{]at"), 2).when(value.rlike(r"[:\[({]"), 1).otherwise(0)
    return [
        F.lit(KINDS.index(kind)), n, yes(n.between(13, 19)) * yes(luhn(digits)), symbols,
        F.least(F.coalesce(F.array_max(parts), F.lit(0)), F.lit(9999)), F.least(size, F.lit(99)), yes(before.rlike(FOR[kind])), yes(before.rlike(AGAINST)),
        yes(before.rlike(r"[\p{L}0-9]$")) + yes(after.rlike(r"[\p{L}0-9]")), style, yes(value.rlike(rf"[. )\]}}](?:{TOP_DOMAINS})$")),
    ]


def _guard(kind: str, loose: bool) -> Column:
    text = F.col("_text")
    if loose and kind == "email":
        return text.contains("@") | text.rlike(r"(?i)at[\x20)\]}]")
    if loose:
        return text.rlike("[0-9]{2}" if kind != "ip" else r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9][\x20]?[(\[{]\.")
    return text.contains("@") if kind == "email" else text.rlike(NEEDS[kind])


def proposals(rows: DataFrame, text: str) -> DataFrame:
    """Add a column of loose matches per kind, as ``_loose_<kind>``."""
    for kind in KINDS:
        rows = _matches(rows, text, LOOSE[kind], f"_loose_{kind}", _guard(kind, True))
    return rows


def _templates(seed: int = 1) -> list[tuple[str, str, int, str]]:
    """(sentence, kind, 1 for personal data, span) examples for the trees."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(("anna", "bruno", "mail", "info", "carla.t", "j_doe", "max77", "office", "sam", "lea-k"))
    host = lambda: rng.choice(("example", "mailhost", "post-box", "uni", "firma", "web4"))
    end = lambda: rng.choice(("com", "org", "net", "de", "fr", "es", "io"))
    byte = lambda: str(rng.randint(1, 255))
    noun = lambda: rng.choice(("house", "table", "garden", "meeting", "river", "street", "idea"))

    def card(valid: bool) -> str:
        body = rng.choice("3456") + d(14)
        sums = [sum((int(c) * 2 % 10 + int(c) // 5) if i % 2 == 0 else int(c) for i, c in enumerate(body + e)) % 10 == 0 for e in "0123456789"]
        return body + rng.choice([e for e, ok in zip("0123456789", sums) if ok == valid])

    def grouped(digits: str, mark: str) -> str:
        return mark.join(digits[i:i + 4] for i in range(0, 16, 4))

    lead = lambda *words: rng.choice(("", "please ", "then ", "we said ")) + rng.choice(words)
    made = []
    for _ in range(EXAMPLES):
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), ("{at}", ".")))
        made += [
            (lead("mail ", "contact ", "write to ", ""), "email", 1, f"{word()}{at}{host()}{dot}{end()}"),
            (lead("mail ", "e-mail ", "contact "), "email", 1, f"{word()} at {host()} dot {end()}"),
            (lead("mail ", "reach me: ", ""), "email", 1, f"{word()} @ {host()}.{end()}"),
            (lead("they met ", "look ", "we are "), "email", 0, f"{noun()} at {noun()}.{noun()}"),
            (lead("she was ", "paint the ", "see "), "email", 0, f"{noun()} at {noun()} dot {noun()}"),
            (lead("sold ", "size "), "email", 0, f"{d(1)} @ {d(2)}.{d(2)}"),
            (lead("host ", "server ip ", "login from ", "address "), "ip", 1, ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8))),
            (lead("host ", "ip ", ""), "ip", 1, rng.choice(("[.]", "(.)")).join(byte() for _ in range(4))),
            (lead("at ", "date ", "took "), "ip", 0, f"{d(2)}:{d(2)}:{d(2)}:{d(2)}"),
            (lead("mac ", "device "), "ip", 0, ":".join(f"{rng.randint(0, 255):02x}" for _ in range(6))),
            (lead("ratio ", "score "), "ip", 0, ":".join(str(rng.randint(1, 9)) for _ in range(4))),
            (lead("card ", "visa ", "pay with ", ""), "card", 1, grouped(card(True), rng.choice((".", "/", "_", "  ", " - "[1:])))),
            (lead("card ", "visa "), "card", 1, grouped(card(True), ".")),
            (lead("card ", "serial ", "order ", ""), "card", 0, grouped(card(False), rng.choice((".", "/", "_", "  ", "", " ", "-")))),
            (lead("order ", "tracking ", "lot ", "sku "), "card", 0, grouped(card(rng.random() < 0.1), rng.choice((".", "/", "", "_")))),
            (lead("isbn ", "article "), "card", 0, "978" + d(10)),
            (lead("call ", "tel ", "phone ", "mobile ", "fax "), "phone", 1, f"({d(3)}) {d(3)}-{d(4)}"),
            (lead("call ", "tel ", "phone "), "phone", 1, rng.choice((" ", "-", ".")).join((d(3), d(3), d(4)))),
            (lead("call ", "tel ", "phone ", "fax "), "phone", 1, f"00{d(2)} {d(3)} {d(3)} {d(4)}"),
            (lead("from ", "about ", "section ", "total "), "phone", 0, rng.choice((" ", "-", ".")).join((d(3), d(3), d(4)))),
            (lead("date ", "on "), "phone", 0, f"20{d(2)}-{d(3)}-{d(3)}"),
            (lead("order ", "invoice ", "ref "), "phone", 0, f"{d(4)}-{d(4)}-{d(4)}"),
            (lead("", "of "), "phone", 0, f"{d(3)} {d(3)} {d(3)}"),
        ]
    tails = (" today", ".", ", thanks", " and more")
    return [(a + span + rng.choice(tails), kind, label, span) for a, kind, label, span in made]


@cache
def fit(spark: SparkSession, precision: float = PRECISION) -> tuple[Boosted, dict[str, float]]:
    """The trees and the threshold of each kind; every third example is held out for the thresholds."""
    made = _templates()
    listed = json.dumps([{"n": i, "_text": s, "of": k, "y": y} for i, (s, k, y, _) in enumerate(made)])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<n:int,_text:string,of:string,y:int>>")))
    found = proposals(rows, "_text")

    def described(k: str) -> Column:
        return F.transform(f"_loose_{k}", lambda s: F.struct(F.lit(k).alias("kind"), F.array(*[f.cast("int") for f in _features(F.col("_text"), k, s)]).alias("x")))

    every = F.concat(*map(described, KINDS))
    got = found.select("n", "of", "y", F.inline(every)).collect()
    x = np.array([r["x"] for r in got])
    y = np.array([r["y"] if r["kind"] == r["of"] else 0 for r in got], float)
    held, kinds = np.array([r["n"] % 3 == 0 for r in got]), np.array([r["kind"] for r in got])
    model = Boosted.fit(x[~held], y[~held], ROUNDS)
    p = model.predict(x[held])
    return model, {k: cutoff(p[kinds[held] == k], y[held][kinds[held] == k], precision) for k in KINDS}


def find(docs: DataFrame, model: Boosted | None = None, thresholds: dict[str, float] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``base`` and ``added``: arrays of (kind, start, end) of the personal data in ``text``.

    Kinds count as in KINDS. A null text is an empty one and has no spans. Added spans
    never overlap base spans or each other. Rows are independent of each other; other columns are
    ignored unless kept; an empty table gives no rows. Pass ``model`` and ``thresholds`` to reuse a fit.
    """
    if model is None or thresholds is None:
        model, thresholds = fit(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    for kind in KINDS:
        rows = _matches(rows, "_text", BASE[kind], f"_base_{kind}", _guard(kind, False))
    rows = proposals(rows, "_text")

    def valid(k: str) -> Column:
        passed = F.filter(f"_base_{k}", lambda s: _valid(k, s["value"]))
        return F.transform(passed, lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    rows = rows.withColumn("base", F.concat(*map(valid, KINDS)))
    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def scored(k: str) -> Column:
        described = F.transform(F.filter(f"_loose_{k}", apart), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.array(*[f.cast("int") for f in _features(F.col("_text"), k, s)]).alias("x")))
        judged = F.transform(described, lambda s: F.struct(
            F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            model.column([s["x"][i] for i in range(len(FEATURES))]).alias("p")))
        return F.filter(judged, lambda s: s["p"] >= thresholds[k])

    rows = rows.withColumn("_likely", F.concat(*[scored(k) for k in KINDS]))
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(a["kind"] - b["kind"])
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    swept = F.aggregate(
        F.array_sort("_likely", order), F.struct(none.alias("kept"), F.lit(0).cast("bigint").alias("upto")),
        lambda acc, s: F.when(s["start"] < acc["upto"], acc).otherwise(F.struct(
            F.concat(acc["kept"], F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).alias("kept"), s["end"].alias("upto"))),
        lambda acc: acc["kept"])
    return rows.select(*keep, "base", F.when(F.size("_likely") > 0, swept).otherwise(none).alias("added"), "_text").withColumnRenamed("_text", "scanned")


def listed(spans: Column) -> Column:
    """``kind:start:end`` by kind, then start, joined by commas."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def report(docs: DataFrame, **fitted) -> DataFrame:
    """Per row: doc_id, counts of base spans, the digest of their list, and the list of all spans."""
    found = find(docs, **fitted)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, **fitted) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; all other columns stay.

    Overlapping spans are replaced as one, by the kind of the first. ``n_chars``, where there is
    one, is set to the new length of a changed text. Null texts stay null.
    """
    found = find(docs.withColumn("_whole", F.struct(*docs.columns)), keep=("_whole",), **fitted)
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    merged = F.aggregate(spans, none, lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"), F.try_element_at(acc, F.lit(-1))["kind"].alias("kind")))),
    ).otherwise(F.concat(acc, F.array(s))))
    rows = found.withColumn("_spans", F.when(F.size("base") + F.size("added") > 0, merged))
    tag = lambda s: F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k.upper()) for k in KINDS]), s["kind"] + 1), F.lit("]"))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_spans", lambda s: s["end"]))
    cut = lambda a, b: F.substring("scanned", a.cast("int") + 1, (b - a).cast("int"))
    parts = F.zip_with("_spans", F.slice(ends, 1, F.size("_spans")), lambda s, e: F.concat(cut(e, s["start"]), tag(s)))
    tail = F.substring(F.col("scanned"), F.element_at(ends, -1).cast("int") + 1, F.char_length("scanned"))
    changed = F.size("_spans") > 0
    rows = rows.withColumn("_new", F.when(changed, F.concat(F.array_join(parts, ""), tail)))
    out = {c: F.col("_whole")[c] for c in docs.columns}
    out["text"] = F.coalesce("_new", F.col("_whole")["text"])
    if "n_chars" in out:
        kept = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(changed, F.char_length("_new").cast(kept)).otherwise(F.col("_whole")["n_chars"])
    return rows.select(*[c.alias(n) for n, c in out.items()])
