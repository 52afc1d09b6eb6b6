"""SQL fragments used by the check queries."""

from __future__ import annotations

from factloom import config as C


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def subject_key(x: str) -> str:
    out = f"regexp_replace({strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '[（(][^）)]*[）)]', '', 'g')"
    for suffix in ("股份有限公司", "有限责任公司", "有限公司", "集团公司", "集团", "控股"):
        out = f"regexp_replace({out}, '(.){suffix}$', '\\1')"
    return f"lower({strip(out)})"


def norm_name(x: str) -> str:
    bare = strip(f"regexp_replace({x}, '[（(][^）)]*[）)]', '', 'g')")
    return strip(f"regexp_replace({bare}, '(有限公司|有限责任公司|股份公司)$', '')")


def qual(key: str, col: str = "qualifier_json") -> str:
    return f"(CASE WHEN json_valid({col}) THEN json_extract_string({col}, '$.{key}') END)"


def discriminator() -> str:
    fallback = "coalesce(predicate, '')"
    own = f"""CASE fact_type WHEN 'FINANCIAL_METRIC' THEN {qual('metric_name')}
      WHEN 'INVESTMENT' THEN object_text WHEN 'EXPANSION' THEN {qual('project_name')}
      WHEN 'CAPACITY' THEN {qual('product_type')} WHEN 'SALES_VOLUME' THEN {qual('metric_name')}
      WHEN 'MARKET_SHARE' THEN {qual('market_scope')} WHEN 'COMPETITIVE_RANKING' THEN {qual('ranking_scope')}
      WHEN 'COOPERATION' THEN object_text WHEN 'PRICE_CHANGE' THEN {qual('price_type')} END"""
    return f"lower({strip(f'coalesce(nullif({own}, {chr(39)}{chr(39)}), {fallback})')})"


FACT_KEY = f"""coalesce(fact_type, '') AS k_type, {subject_key('subject_text')} AS k_subject,
  {discriminator()} AS k_disc, value_num AS k_value, {strip("coalesce(time_expr, '')")} AS k_time"""

KEYS = "k_type, k_subject, k_disc, k_value, k_time"
ACTIVE = "review_status NOT IN ('已拒绝', '重复', '人工拒绝')"
APPROVED = "review_status IN ('自动通过', '人工通过')"
BEST = "confidence_score DESC NULLS LAST, created_at, fact_id"


def contain_score(a: str, b: str) -> str:
    return f"""CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0e0 WHEN {a} = {b} THEN 1e0
      WHEN contains({a}, {b}) OR contains({b}, {a})
        THEN CAST(least(length({a}), length({b})) AS DOUBLE) / greatest(length({a}), length({b})) * 45e-2 + 5e-1
      ELSE 0e0 END"""


def place(x: str) -> str:
    inner = strip(f"regexp_extract({x}, '[（(]([^）)]+)[）)]', 1)")
    listed = ", ".join(f"'{p}'" for p in C.PLACE_QUALIFIERS)
    return f"(CASE WHEN {inner} IN ({listed}) THEN {inner} END)"


def cost(i: str, o: str) -> str:
    return f"round({i} / 1e6 * 2e0 + {o} / 1e6 * 3e0, 4)"
