import json

from factloom.functions.predicates import normalize_predicates

# fixed values: predicate in, predicate out
CASES = [
    ("青岛工厂产能达到", "产能达到"), ("在中国销售收入为", "销售收入为"), ("一期工程年产能增加", "年产能增加"),
    ("新造船涂料销售量为", "销售量为"), ("维修保养涂料销售量为", "销售量为"), ("全厂船舶涂料产能增加至", "产能增加至"),
    ("2024年销售额为", "销售额为"), ("连续3年创下销售额和盈利纪录", "创下销售额和盈利纪录"),
    ("张家港高性能涂料新工厂及液体涂料研发中心项目建设", "建设"), ("船舶涂料改造项目（一期）通过验收", "通过验收"),
    ("张家港基地预计年产值冲刺", "预计年产值冲刺"), ("区2024年销售额接近", "销售额接近"), ("青岛工厂生产效率为", "生产效率为"),
    ("青岛工厂一次合格率为", "一次合格率为"), ("位居中国船舶涂料产销量第一", "位居第一"), ("是北欧涂料市场的领导者", "是领导者"),
    ("投建高性能涂料新工厂及研发中心项目签约", "投建签约"),
    ("计划投资建设张家港高性能涂料新工厂及液体涂料研发中心项目", "计划投资建设"),
    ("一期工程已建成", "已建成"), ("二期工程计划开工", "计划开工"), ("在埃塞俄比亚建厂", "建厂"),
    ("在阿尔及利亚建厂", "建厂"), ("船舶涂料产销量排名第一", "产销量排名第一"),
]


def _run(spark, rows):
    df = spark.createDataFrame(
        rows, "id int, predicate string, time_expr string, location_text string, qualifier_json string")
    return {r["id"]: r for r in normalize_predicates(df).collect()}


def test_rewrites(spark):
    out = _run(spark, [(i, p, None, None, "{}") for i, (p, _) in enumerate(CASES)])
    got = [(CASES[i][0], out[i]["predicate"]) for i in range(len(CASES))]
    bad = [(g, w) for g, w in zip(got, CASES) if g != w]
    assert not bad, bad


def test_fields_are_filled_not_overwritten(spark):
    out = _run(spark, [
        (0, "2024年综合销售额", None, None, "{}"),
        (1, "2024年销售额", "2023年", None, "{}"),
        (2, "在国内销售收入为", None, None, "{}"),
        (3, "青岛工厂产能达到", None, None, '{"report_scope": "", "is_forecast": true}'),
        (4, "连续3年盈利", None, None, '{"duration": "两年", "yoy": "5%"}'),
        (5, "船舶涂料产能为", None, None, "not json"),
        (6, "环氧项目产能为", None, None, '{"product_type": "环氧"}'),
    ])
    assert (out[0]["predicate"], out[0]["time_expr"]) == ("综合销售额为", "2024年")
    assert out[1]["time_expr"] == "2023年"
    assert out[2]["location_text"] == "中国"
    assert json.loads(out[3]["qualifier_json"]) == {"is_forecast": True, "report_scope": "青岛工厂"}
    assert json.loads(out[4]["qualifier_json"]) == {"yoy": "5%", "duration": "连续3年"}
    assert json.loads(out[5]["qualifier_json"]) == {"product_type": "船舶涂料"}
    assert json.loads(out[6]["qualifier_json"]) == {"product_type": "环氧"}
    assert out[6]["predicate"] == "产能为"


def test_nested_and_listed_qualifiers_survive(spark):
    out = _run(spark, [
        (0, "一期工程已建成", None, None, '{"detail":{"phase":"keep me"},"k":"v"}'),
        (1, "连续3年增长", None, None, '{"duration":["a","b"],"k":"v"}'),
        (2, "一期工程已建成", None, None, '{"phase":"","text":"a \\"phase\\": {x}, \\\\","n":1.50,"list":[{"phase":""}]}'),
        (3, "销售额为", None, None, "[not an object"),
        (4, "销售额为", None, None, '{"detail":{"a":1}, "x":  2}'),
        (5, "一期工程已建成", None, None, None),
    ])
    assert json.loads(out[0]["qualifier_json"]) == {"detail": {"phase": "keep me"}, "k": "v", "phase": "一期工程"}
    assert json.loads(out[1]["qualifier_json"]) == {"k": "v", "duration": "连续3年"}
    assert json.loads(out[2]["qualifier_json"]) == {"phase": "一期工程", "text": 'a "phase": {x}, \\', "n": 1.5, "list": [{"phase": ""}]}
    assert out[3]["qualifier_json"] == "[not an object" and out[4]["qualifier_json"] == '{"detail":{"a":1}, "x":  2}'
    assert json.loads(out[5]["qualifier_json"]) == {"phase": "一期工程"}
