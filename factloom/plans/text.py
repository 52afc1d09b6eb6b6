"""Text preparation."""

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import textprep
from factloom.plans.registry import query
from factloom.plans.snippets import strip

_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _html(x: str) -> str:
    out = rf"regexp_replace({x}, '(?i)<br\s*/?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?i)</p>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for a, b in T.ENTITIES:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _ads(x: str) -> str:
    nav = ", ".join(f"'{w}'" for w in T.NAV_LINES)
    ad = "|".join(f"(?:{p})" for p in T.AD_LINE_PATTERNS)
    line = _strip("l")
    return (f"array_to_string(list_filter(string_split({x}, chr(10)), "
            f"lambda l: NOT ({line} IN ({nav}) OR regexp_matches({line}, '{ad}'))), chr(10))")


def _space(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def _clean(x: str) -> str:
    return _strip(_space(_ads(_html(x))))


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("raw_text"))


@query("T1_clean", f"SELECT doc_id AS document_id, {_clean('text')} AS clean_text FROM documents")
def t1(t):
    return _docs(t).select("document_id", T.clean(F.col("raw_text")).alias("clean_text"))


@query("T2_strip_html", f"SELECT page_id, md5({_html('html')}) AS body_md5 FROM pages")
def t2(t):
    return t.pages.select("page_id", F.md5(T.strip_html(F.col("html"))).alias("body_md5"))


@query("T3_tables")
def t3(t):
    return t.pages.select("page_id", F.length(T.tables_to_text(F.col("html"))).alias("n_chars"))


@query("T4_ad_lines", f"SELECT doc_id, {_ads('text')} AS kept FROM documents")
def t4(t):
    return t.documents.select("doc_id", T.drop_ad_lines(F.col("text")).alias("kept"))


@query("T5_whitespace", f"SELECT doc_id, {_space('text')} AS tidy FROM documents")
def t5(t):
    return t.documents.select("doc_id", T.normalize_whitespace(F.col("text")).alias("tidy"))


@query("T6_sizes", f"""
SELECT doc_id, length(text) - length(regexp_replace(text, '[{_CJK}]', '', 'g')) AS cjk_chars,
  length(text) - length(regexp_replace(text, '[{_CJK}]', '', 'g'))
  + length(regexp_replace(text, '[{_CJK}{_WS}]', '', 'g')) // 5 AS effective_chars FROM documents""")
def t6(t):
    return t.documents.select(
        "doc_id", T.cjk_chars(F.col("text")).alias("cjk_chars"), T.effective_chars(F.col("text")).alias("effective_chars"))


@query("T7_chunks")
def t7(t):
    cleaned = textprep.clean_documents(_docs(t))
    return textprep.split_chunks(cleaned).select(
        "document_id", "chunk_index", F.length("chunk_text").alias("n_chars"), "char_start", "char_end")


@query("T8_paragraphs", f"""
WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n')) AS body FROM documents)
SELECT doc_id, count(*) AS n, sum(length({_strip('body')})) AS chars FROM p
WHERE {_strip('body')} <> '' GROUP BY doc_id""")
def t8(t):
    # single line breaks are doubled so that every line is a paragraph
    # the outer form keeps Spark from deriving a filter that would repeat all the text work
    rows = t.documents.select("doc_id", F.explode_outer(
        T.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("p")).filter("p is not null")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.length("p.body")).alias("chars"))


@query("T9_packed_chunks")
def t9(t):
    wide = _docs(t).select("document_id", F.replace("raw_text", F.lit("\n"), F.lit("\n\n")).alias("clean_text"))
    return textprep.split_chunks(wide).groupBy("document_id").agg(
        F.count("*").alias("n_chunks"), F.max(T.effective_chars(F.col("chunk_text"))).alias("largest"))


@query("T10_sentences", f"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？；;!?]*[。！？；;!?]|[^。！？；;!?]+')) AS piece FROM documents)
SELECT doc_id AS document_id, count(*) AS n, sum(length({_strip('piece')})) AS chars FROM s
WHERE {_strip('piece')} <> '' GROUP BY doc_id""")
def t10(t):
    rows = textprep.sentence_rows(_docs(t), "raw_text")
    return rows.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence_text")).alias("chars"))


@query("T11_gate", f"""
WITH c AS (SELECT doc_id, text, {_clean('text')} AS c FROM documents)
SELECT doc_id AS document_id, CASE WHEN {_strip('text')} = '' THEN '内容为空' WHEN c = '' THEN '清洗后为空'
  WHEN length(c) < 100 THEN '内容过短' END AS stop_status,
  CASE WHEN length(c) BETWEEN 1 AND 99 THEN '清洗后仅 ' || length(c) || ' 字符，低于阈值 100' END AS stop_reason FROM c""")
def t11(t):
    return textprep.clean_documents(_docs(t)).select("document_id", "stop_status", "stop_reason")


@query("T12_whole_text_chunks", f"""
WITH c AS (SELECT doc_id, {_clean('text')} AS c FROM documents)
SELECT doc_id AS document_id, 0 AS chunk_index, c AS chunk_text, length(c) AS char_count FROM c WHERE length(c) >= 100""")
def t12(t):
    return textprep.whole_text_chunks(textprep.clean_documents(_docs(t))).drop("chunk_id")
