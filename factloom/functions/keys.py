"""Name and fact keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import config as C


# every character Unicode calls white space, and the four ASCII separators
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides (no regex: names and texts are trimmed a lot)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def subject_key(col: Column) -> Column:
    """Subject as compared by de-duplication: no brackets, no company suffixes, lower case.

    Suffixes are tried once each, in list order, and never eat the whole name.
    """
    out = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), C.BRACKETED, "")
    for suffix in C.SUBJECT_SUFFIXES:
        out = F.regexp_replace(out, rf"(?s)(.){suffix}\z", "$1")
    return F.lower(strip(out))


def normalized_name(col: Column) -> Column:
    """Entity name without brackets and without its first matching legal suffix."""
    out = strip(F.regexp_replace(col, C.BRACKETED, ""))
    # First listed suffix wins, once. "有限公司" leads the list, so the longer forms
    # ending in it are never reached and one alternation says the same.
    return strip(F.regexp_replace(out, r"(?:有限公司|有限责任公司|股份公司)\z", ""))


def qualifiers(col: Column) -> Column:
    """Qualifier JSON as a map; anything but an object becomes an empty map."""
    parsed = F.from_json(col, "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def members(col: Column) -> Column:
    """Top-level members of a JSON object with their values as they are; empty for anything else."""
    parsed = F.try_variant_get(F.try_parse_json(col), "$", "map<string,variant>")
    return F.coalesce(parsed, F.create_map().cast("map<string,variant>"))


_DISCRIMINATOR_KEY = {
    "FINANCIAL_METRIC": "metric_name",
    "EXPANSION": "project_name",
    "CAPACITY": "product_type",
    "SALES_VOLUME": "metric_name",
    "MARKET_SHARE": "market_scope",
    "COMPETITIVE_RANKING": "ranking_scope",
    "PRICE_CHANGE": "price_type",
}


def discriminator(fact_type: Column, quals: Column, predicate: Column, object_text: Column) -> Column:
    """What tells two facts of one type and subject apart."""
    key = F.create_map(*[F.lit(x) for kv in _DISCRIMINATOR_KEY.items() for x in kv])[fact_type]
    own = F.when(fact_type.isin("INVESTMENT", "COOPERATION"), object_text) \
        .otherwise(F.try_element_at(quals, key))
    return F.lower(strip(F.coalesce(F.nullif(own, F.lit("")), predicate, F.lit(""))))


KEY_COLUMNS = ("k_type", "k_subject", "k_disc", "k_value", "k_time")


def fact_key_columns() -> dict[str, Column]:
    """The five parts of a fact fingerprint, ready for ``withColumns``."""
    c = F.col
    return {
        "k_type": F.coalesce(c("fact_type"), F.lit("")),
        "k_subject": subject_key(c("subject_text")),
        "k_disc": discriminator(
            c("fact_type"), qualifiers(c("qualifier_json")), c("predicate"), c("object_text")),
        # -0.0 and 0.0 are one value
        "k_value": F.when(c("value_num") == 0, F.lit(0.0)).otherwise(c("value_num")),
        "k_time": strip(F.coalesce(c("time_expr"), F.lit(""))),
    }


def fact_fingerprint() -> Column:
    """The five parts of a fact's key as one digest of 16 bytes: what is shuffled and compared instead of five texts."""
    parts = fact_key_columns()
    texts = [parts[n] for n in KEY_COLUMNS if n != "k_value"]
    # lengths first, so that no two keys are written alike
    return F.unhex(F.md5(F.concat_ws("|", *[F.length(x) for x in texts], F.coalesce(parts["k_value"].cast("string"), F.lit("")), *texts)))


def contain_score(a: Column, b: Column) -> Column:
    """1 if equal, 0.5..0.95 by length ratio if one contains the other, else 0."""
    la, lb = F.length(a), F.length(b)
    ratio = F.least(la, lb).cast("double") / F.greatest(la, lb)
    return (
        F.when(a.isNull() | b.isNull() | (la == 0) | (lb == 0), 0.0)
        .when(a == b, 1.0)
        .when(a.contains(b) | b.contains(a), ratio * 0.45 + 0.5)
        .otherwise(0.0)
    )


def bracketed_place(col: Column) -> Column:
    """Place inside the first non-empty bracket, if it is a listed place."""
    inner = strip(F.regexp_extract(col, r"[（(]([^）)]+)[）)]", 1))
    return F.when(inner.isin(*C.PLACE_QUALIFIERS), inner)


def has_region_word(col: Column) -> Column:
    """Name starts or ends with a country or region word."""
    words = "|".join(C.REGION_WORDS)
    return col.rlike(rf"^(?:{words})|(?:{words})\z")


def _any_of(words) -> str:
    return "(?:" + "|".join(words) + ")"


def entity_type(text: Column, fact_type: Column) -> Column:
    """Type of an entity from its name; the first rule that holds decides."""
    ends = lambda words: text.rlike(_any_of(words) + r"\z")
    has = lambda words: text.rlike(_any_of(words))
    places = F.create_map(*[F.lit(x) for kv in C.PLACE_TYPES.items() for x in kv])
    n = F.length(text)
    return (
        F.when(text.isNull() | (text == ""), "UNKNOWN")
        .when(ends(C.METRIC_ENDINGS), "UNKNOWN")
        .when(ends(C.PROJECT_ENDINGS), "PROJECT")
        .when(has(C.FACILITY_WORDS) & ~has(C.CORPORATE_WORDS), "PROJECT")
        .when(has(C.GROUP_WORDS), "GROUP")
        .when(text.contains(C.BRAND_WORD) & has(C.BRAND_SCOPES), "GROUP")
        .when(text.endswith("市场") & (n > 2), "MARKET")
        .when(ends(C.INDUSTRY_ENDINGS) & (n > 2), "INDUSTRY")
        .when(has(C.COMPANY_WORDS), "COMPANY")
        .when(ends([core + "业" for core in C.INDUSTRY_CORES]), "INDUSTRY")
        .when(ends(C.REGION_ENDINGS), "REGION")
        .when(places[text].isNotNull(), places[text])
        .when(fact_type == "COOPERATION", "PROJECT")
        .otherwise("UNKNOWN")
    )


def entity_tags(text: Column, kind: Column) -> Column:
    """Extra tags, carried by companies only."""
    tag = lambda word, name: F.when((kind == "COMPANY") & text.contains(word), F.lit(name))
    return F.array_compact(F.array(tag("集团", "group"), tag(C.BRAND_WORD, "brand")))
