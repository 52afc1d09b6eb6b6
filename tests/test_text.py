"""Cleaning, chunking and page extraction on small literal inputs."""

import random
import re

from pyspark.sql import functions as F

from factloom.config import ChunkRules
from factloom.functions import text as T
from factloom.operators import textprep
from factloom.sources import documents as D
from factloom.sources.html import extract_pages, with_title


def _one(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t"))).orderBy("i").collect()]


def test_clean(spark):
    out = _one(spark, T.clean, "<p>公司<b>营收</b>889.37亿</p>", "a  \t b", "正文\n免责声明：本文仅供参考\n增长26.34%", "  \n ",
               "<table><tr><td>项目</td><td>金额</td></tr><tr><td></td></tr><tr><td>总投资</td><td>100亿</td></tr></table>",
               "首页\n正文\n更多", "a &amp;lt; b", "x\n\n\n\ny")
    assert out[0] == "公司营收889.37亿" and out[1] == "a b"
    assert out[2] == "正文\n增长26.34%" and out[3] == ""
    assert out[4] == "项目 | 金额\n总投资 | 100亿"
    assert out[5] == "正文" and out[6] == "a < b" and out[7] == "x\n\ny"


def test_sizes(spark):
    assert _one(spark, T.effective_chars, "你好世界", "hello world", "你好 hello", "") == [4, 2, 3, 0]


def _eff(s):
    cjk = len(re.findall(r"[一-鿿㐀-䶿]", s))
    return cjk + len(re.sub(r"[一-鿿㐀-䶿\s]", "", s)) // 5


def _expected_chunks(text, limit, overlap):
    """Brute force: build the chunk texts directly."""
    if not text.strip():
        return []
    if _eff(text) <= limit:
        return [text]
    out, buf = [], []
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not para:
            continue
        if _eff(para) > limit:
            if buf:
                out.append("\n\n".join(buf))
            buf, run = [], []
            for s in (x.strip() for x in re.split(r"(?<=[。！？；;!?])", para)):
                if not s:
                    continue
                if run and sum(map(_eff, run)) + _eff(s) > limit:
                    out.append(" ".join(run))
                    run = []
                run.append(s)
            if run:
                out.append(" ".join(run))
            continue
        if buf and sum(map(_eff, buf)) + _eff(para) > limit:
            out.append("\n\n".join(buf))
            buf = [buf[-1]] if _eff(buf[-1]) <= overlap else []
        buf.append(para)
    if buf:
        out.append("\n\n".join(buf))
    return out


def test_chunks_match_brute_force(spark):
    rng = random.Random(3)
    texts = ["", "  \n ", "短文一段"]
    for _ in range(60):
        paras = []
        for _ in range(rng.randint(1, 12)):
            n = rng.choice([3, 8, 20, 70])
            paras.append("".join(rng.choice("涂料产能增长。！a b") for _ in range(n)))
        texts.append(rng.choice(["\n\n", "\n \n", "\n\n\n"]).join(paras))
    rules = ChunkRules(short_text=40, chunk_max=40, overlap=10)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "document_id int, clean_text string")
    rows = textprep.split_chunks(df, rules=rules).orderBy("document_id", "chunk_index").collect()
    got = {}
    for r in rows:
        got.setdefault(r["document_id"], []).append(r["chunk_text"])
        assert r["chunk_index"] == len(got[r["document_id"]]) - 1
        assert 0 <= r["char_start"] <= r["char_end"] <= len(texts[r["document_id"]])
    for i, t in enumerate(texts):
        assert got.get(i, []) == _expected_chunks(t, 40, 10), t


def test_pages(spark):
    pages = [
        (1, "u1", "<html><head><title>T</title></head><body><nav>菜单</nav><article><h1>标题</h1><p>第<span>一</span>段</p>"
                  "<p>x</p><p>第二段<br>换行</p><script>no()</script></article><footer>f</footer></body></html>"),
        (2, "u2", "<html><head><meta property='og:title' content=' OG '><title>T</title></head><body><main><div>甲</div>乙</main></body></html>"),
        (3, "http://u3", "<body>  plain   text <div>块</div></body>"),
        (4, "http://u4", "<p>ab</p>"),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    out = {r["page_id"]: r for r in with_title(extract_pages(df)).collect()}
    assert out[1]["raw_text"] == "标题\n\n第一段\n\n第二段\n\n换行" and out[1]["title"] == "标题"
    assert out[2]["raw_text"] == "甲\n\n乙" and out[2]["title"] == "OG"
    assert out[3]["raw_text"] == "plain text\n\n块" and out[3]["title"] == "plain text"
    assert out[4]["title"] == "http://u4"


def test_files_and_upsert(spark, tmp_path):
    (tmp_path / "a.txt").write_text("正文一", encoding="utf-8")
    (tmp_path / "b.md").write_text("正文二", encoding="utf-8")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "urls.lst").write_text("# list\n\n http://a \nhttp://b\n")
    good, bad = D.folder(spark, str(tmp_path), "*.txt")
    assert [r["title"] for r in good.collect()] == ["a"] and [r["source_name"] for r in bad.collect()] == ["bad.txt"]
    assert {r["title"] for r in D.text_files(spark, str(tmp_path)).filter("title <> 'bad'").collect()} == {"a", "b"}
    assert [r["url"] for r in D.url_list(spark, str(tmp_path / "urls.lst")).collect()] == ["http://a", "http://b"]

    text = spark.createDataFrame([("t1", "同一正文", 1), ("t2", "同一正文", 2)], "title string, raw_text string, seq int")
    incoming = D.pasted(text).withColumn("seq", F.when(F.col("title") == "t1", 1).otherwise(2))
    empty = incoming.limit(0).drop("seq").withColumn("document_id", F.lit("")).withColumn("status", F.lit(""))
    docs, _ = D.upsert(empty, incoming, "seq")
    rows = docs.collect()
    assert len(rows) == 1 and rows[0]["title"] == "t2" and rows[0]["change"] == "inserted"
    again, _ = D.upsert(docs.drop("change"), incoming, "seq")
    assert [(r["document_id"], r["change"]) for r in again.collect()] == [(rows[0]["document_id"], "updated")]
