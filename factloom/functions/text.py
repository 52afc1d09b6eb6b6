"""Cleaning, measuring and chunking of document text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from factloom import config as C
from factloom.config import ChunkRules, CleanRules
from factloom.functions.keys import WHITE_SPACE, strip

# --- fixed values: patterns of advertisement and navigation lines ---------
AD_LINE_PATTERNS = (
    r"(点击|扫码|关注|订阅|加入)(我们的)?[^。]{0,20}(公众号|微信|群|社群)",
    r"(免责声明|版权声明|法律声明|声明)[：:]",
    r"(转载|来源)[：:].*?(网|报|号|社|台)",
    r"(联系我们|联系方式|电话|邮箱|地址)[：:]",
    r"(上一篇|下一篇|相关阅读|推荐阅读|热门文章)",
    r"^(首页|导航|登录|注册|返回顶部|注销登录|注销)$",
    r"(©|版权所有|All [Rr]ights [Rr]eserved)",
    r"(广告|推广|赞助|商务合作)",
)
# --- fixed values: lines that are only a menu entry -----------------------
NAV_LINES = (
    "首页", "视频", "资讯", "图片", "专题", "论坛",
    "登录", "注册", "注销", "搜索", "分享", "收藏",
    "关注", "评论", "举报", "返回", "更多", "加载中",
    "展开", "收起", "特别策划", "热门", "最新", "推荐",
    "会员单位", "通知公告", "组织架构", "协会简介",
    "协会章程", "协会宗旨", "协会新闻", "党建专题",
    "分支机构", "关于协会", "会员动态", "证书查询",
    "联系协会", "会议专栏", "会议直播", "通知下载",
    "在线报名", "投票问卷", "会议报道", "行规行约",
)
TAG = r"<[^>]+>"
TABLE = r"(?is)<table[^>]*>(.*?)</table>"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
CJK = r"\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}"
# order matters: an escaped entity such as &amp;lt; ends up decoded
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'))
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
SENTENCE_END = r"(?<=[。！？；;!?])"


def once(value: Column) -> Column:
    """``value`` as a column that Spark computes once a row: what is built on it, filters too, reads it and never repeats it."""
    return F.explode_outer(F.array(value))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tables_to_text(text: Column) -> Column:
    """Replace each simple table by ``a | b`` lines; rows without any text vanish."""

    def row_text(row: Column) -> Column:
        cells = F.transform(
            F.regexp_extract_all(row, F.lit(CELL), F.lit(1)), lambda c: strip(F.regexp_replace(c, TAG, "")))
        return F.when(F.exists(cells, lambda c: c != ""), F.array_join(cells, " | "))

    def table_text(inner: Column) -> Column:
        rows = F.transform(F.regexp_extract_all(inner, F.lit(ROW), F.lit(1)), row_text)
        return F.array_join(F.array_compact(rows), "\n")

    def woven(text: Column) -> Column:
        outside = F.split(text, TABLE)
        inside = F.transform(F.regexp_extract_all(text, F.lit(TABLE), F.lit(1)), table_text)
        return F.flatten(F.zip_with(outside, inside, lambda o, i: F.array(o, F.coalesce(i, F.lit("")))))

    return let(text, lambda t: F.when(t.rlike(r"(?i)<table"), F.array_join(woven(t), "")).otherwise(t))


def strip_html(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</p>", "\n")
    out = F.regexp_replace(tables_to_text(out), TAG, "")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def drop_ad_lines(text: Column) -> Column:
    """Remove advertisement and menu lines; blank lines stay."""
    ad = "(?d)" + "|".join(f"(?:{p})" for p in AD_LINE_PATTERNS)

    def keep(line: Column) -> Column:
        bare = strip(line)
        return ~(bare.isin(*NAV_LINES) | bare.rlike(ad))

    return F.array_join(F.filter(F.split(text, "\n"), keep), "\n")


def normalize_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def clean(text: Column, rules: CleanRules = CleanRules()) -> Column:
    out = text
    if rules.strip_html_tags:
        out = strip_html(out)
    if rules.remove_ads:
        out = drop_ad_lines(out)
    if rules.normalize_whitespace:
        out = normalize_whitespace(out)
    return strip(out)


def cjk_chars(text: Column) -> Column:
    found = F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]+", ""))
    # a text of single-byte characters holds none
    return F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(found).cast("bigint")


def effective_chars(text: Column) -> Column:
    """CJK characters plus one per five other visible characters."""
    visible = F.length(F.translate(text, WHITE_SPACE, ""))
    # cjk + floor((visible - cjk) / 5), with the search for CJK characters written once
    return F.floor((visible + cjk_chars(text) * 4) / 5).cast("bigint")


def running_sums(lengths: Column) -> Column:
    """Sum of the elements before each one (array<bigint>), in two levels so that long arrays stay cheap."""
    none = F.array().cast("array<bigint>")

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(none.alias("a"), start.cast("bigint").alias("s"))
        return F.aggregate(values, first, lambda acc, x: F.struct(
            F.concat(acc["a"], F.array(acc["s"])).alias("a"), (acc["s"] + x).alias("s")), lambda acc: acc["a"])

    def cut(values: Column, step: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / step).cast("int") - 1), lambda b: F.slice(values, b * step + 1, step))

    def filled(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), sums(totals, F.lit(0)).alias("o")), lambda z: sums(z["b"], z["o"])))

    def of(values: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
        return F.when(F.size(values) > 0, let(let(step, lambda n: cut(values, n)), filled)).otherwise(none)

    return let(lengths, of)


def paragraphs(text: Column) -> Column:
    """Array of (body, char_start, char_end, size) for each non-blank paragraph."""
    def sized(text: Column) -> Column:
        gaps = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH_BREAK), F.lit(0)), lambda g: F.length(g))
        return F.zip_with(F.split(text, PARAGRAPH_BREAK), gaps, lambda p, g: F.struct(
            p.alias("part"), F.length(p).alias("n"), F.coalesce(g, F.lit(0)).alias("gap")))

    def placed(parts: Column) -> Column:
        starts = F.transform(running_sums(F.transform(parts, lambda x: x["n"] + x["gap"])), lambda s: s.cast("int"))
        rows = F.zip_with(parts, starts, lambda x, s: F.struct(
            strip(x["part"]).alias("body"), s.alias("char_start"), (s + x["n"]).alias("char_end")))
        full = F.filter(rows, lambda r: r["body"] != "")
        return F.transform(full, lambda r: F.struct(
            r["body"].alias("body"), r["char_start"].alias("char_start"), r["char_end"].alias("char_end"),
            effective_chars(r["body"]).cast("int").alias("size")))

    return let(let(text, sized), placed)


def sentences(text: Column) -> Column:
    pieces = F.transform(F.split(text, SENTENCE_END), strip)
    return F.filter(pieces, lambda s: s != "")


def _pack(sizes, sentence_sizes, limit: int, overlap: int) -> list[list[int]]:
    """Greedy packing over sizes alone: [first para, last para, first sentence, last sentence].

    Sentence positions are -1 for chunks made of whole paragraphs.
    """
    chunks: list[list[int]] = []
    first, held = -1, 0  # open chunk: paragraphs first..i-1, total size

    def close(upto: int) -> None:
        if first >= 0:
            chunks.append([first, upto, -1, -1])

    for i, size in enumerate(sizes):
        if size > limit:
            close(i - 1)
            first, held = -1, 0
            start, total = 0, 0
            inner = sentence_sizes[i]
            for j, n in enumerate(inner):
                if total + n > limit and j > start:
                    chunks.append([i, i, start, j - 1])
                    start, total = j, 0
                total += n
            if len(inner):
                chunks.append([i, i, start, len(inner) - 1])
            continue
        if first >= 0 and held + size > limit:
            close(i - 1)
            # carry the last paragraph over only if it is short
            last = sizes[i - 1]
            first, held = (i - 1, last) if overlap > 0 and last <= overlap else (-1, 0)
        if first < 0:
            first = i
        held += size
    close(len(sizes) - 1)
    return chunks


def packer(rules: ChunkRules):
    """UDF from (paragraph sizes, sentence sizes of oversize paragraphs) to a chunk plan.

    Only sizes go to Python, the text itself stays in the JVM.
    """

    def pack(sizes: pd.Series, inner: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else _pack(a, b, rules.chunk_max, rules.overlap) for a, b in zip(sizes, inner)])

    return F.pandas_udf(pack, ArrayType(ArrayType(IntegerType())))


def with_chunks(docs: DataFrame, text: str, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Add ``chunks``: an array of (chunk_text, char_start, char_end), NULL for blank text."""
    body, sents = F.col("_paras"), F.col("_sents")
    none = F.array().cast("array<string>")
    size = lambda s: effective_chars(s).cast("int")
    df = docs.withColumn("_size", F.when(strip(F.col(text)) != "", effective_chars(F.col(text))))
    long = F.col("_size") > rules.short_text
    df = df.withColumn("_paras", F.when(long, paragraphs(F.col(text))))
    df = df.withColumn("_sents", F.transform(body, lambda p: F.when(p["size"] > rules.chunk_max, sentences(p["body"])).otherwise(none)))
    df = df.withColumn("_plan", packer(rules)(
        F.transform(body, lambda p: p["size"]), F.transform(sents, lambda s: F.transform(s, size))))

    def build(c: Column) -> Column:
        first, last, s, e = c[0], c[1], c[2], c[3]
        whole = F.array_join(F.transform(F.slice(body, first + 1, last - first + 1), lambda p: p["body"]), "\n\n")
        part = F.array_join(F.slice(sents[first], s + 1, e - s + 1), " ")
        return F.struct(
            F.when(s < 0, whole).otherwise(part).alias("chunk_text"),
            body[first]["char_start"].alias("char_start"), body[last]["char_end"].alias("char_end"))

    single = F.array(F.struct(F.col(text).alias("chunk_text"), F.lit(0).alias("char_start"), F.length(text).alias("char_end")))
    return df.withColumn("chunks", F.when(long, F.transform("_plan", build)).when(F.col("_size").isNotNull(), single)).drop(
        "_size", "_paras", "_sents", "_plan")


def gate(raw: Column, cleaned: Column, min_chars: int) -> Column:
    """Terminal status of a document that cannot be extracted from, else NULL."""
    n = F.length(strip(cleaned))
    return (
        F.when(raw.isNull() | (strip(raw) == ""), C.DOC_EMPTY)
        .when(n == 0, C.DOC_EMPTY_CLEAN)
        .when(n < min_chars, C.DOC_TOO_SHORT)
    )
