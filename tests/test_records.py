import json

import pytest
from pyspark.sql import functions as F

from recordlab.operators.quality import keep_nonempty, valid_stats
from recordlab.plans.clean import clean_table
from recordlab.plans.curate import curate, quality_stages
from recordlab.sources import records as rec
from recordlab.sources import tables as io
from recordlab.streaming.quality import read_record_stream, start_filter


def item(name, result, age=50, sex="男", date="2024-03-01"):
    return {"项目名称": name, "结果": result, "年龄": age, "性别": sex, "检验日期": date}


GOOD = {
    "患者编号": "p1",
    "超声": {"检查结论": "ok\n fine", "检查所见": "x"},
    "病理": {},
    "检验": [item("★a", 5.0), item("b", "阳性(+)", date="2024-05-01"), item("b", 0), item("c", "0")],
}
FILES = {
    "one/good.json": GOOD,
    "one/deep/list.json": [{"患者编号": "p2", "检验": [item("a", "1"), item("a", "2"), 7]}],
    "one/empty.json": {"患者编号": "p3", "检验": []},
    "one/object.json": {"患者编号": "p4", "检验": {"a": 1}},
    "one/bad.json": "{broken",
    "one/scalar.json": 5,
    "two/marker.json": {"患者编号": "p5", "检验": [item("a", -1), item("b", -1.0)]},
    "two/text_marker.json": {"患者编号": "p6", "检验": [item("a", "-1"), item("b", 3)]},
    "two/minor.json": {"患者编号": "p7", "检验": [item("a", 1, age="17")]},
    "two/age.json": {"患者编号": "p8", "检验": [item("a", 1, age="58岁")]},
    "two/sparse.json": {"患者编号": "p9", "检验": [item("a", 1), item("b", 1), item("c", 1), item("d", -1), item("e", -1)]},
    "two/late_age.json": {"检验": [item("a", 1, age=None, sex="男"), item("b", 2, age=30, sex="女")]},
}


@pytest.fixture(scope="module")
def dirs(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    for name, doc in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(doc if isinstance(doc, str) else json.dumps(doc, ensure_ascii=False, indent=1), encoding="utf-8")
    return {"one": str(base / "one"), "two": str(base / "two")}


LABELS = {"one": 1, "two": 2}


@pytest.fixture(scope="module")
def result(spark, dirs, tmp_path_factory):
    return curate(spark, dirs, LABELS, out=str(tmp_path_factory.mktemp("out")))


def test_which_records_survive(result):
    assert {r["rec_id"] for r in result["records"].collect()} == {"p1", "p2", "p6", "late_age"}
    assert {r["rec_id"] for r in result["statistics"].collect()} == {"p1", "p2", "p6", "p7", "p8", "p9", "late_age"}
    assert {r["file_name"] for r in result["rejects"].collect()} == {"bad.json", "scalar.json"}


def test_ratio_is_strict(result):
    ratio = {r["rec_id"]: r["ratio"] for r in result["statistics"].collect()}
    assert ratio["p9"] == 0.6 and ratio["p6"] == 1.0


def test_narrative(result):
    text = {r["rec_id"]: (r["label"], r["text"]) for r in result["corpus"].collect()}
    assert text["p1"] == (1, "超声提示：ok fine；年龄：50；性别：男；实验室检查：a 5.0；b 阳性(+)；b ；c 0")
    assert text["p6"] == (2, "年龄：50；性别：男；实验室检查：a -1；b 3")
    assert text["late_age"][1].startswith("年龄：30；性别：女；")


def test_empty_record_text(spark, dirs):
    from recordlab.operators.narrative import narrative

    records = rec.read_records(spark, dirs, LABELS).where("rec_id = 'p3'")
    assert narrative(records).first()["text"] == "无有效检查记录"


def test_wide_table(result):
    rows = {r["rec_id"]: r.asDict() for r in result["wide"].collect()}
    assert list(rows["p1"])[:7] == ["rec_id", "source", "file_name", "path", "label", "age", "sex"]
    assert list(rows["p1"])[8:] == sorted(list(rows["p1"])[8:])
    assert rows["p2"]["a"] == "2" and rows["p1"]["b"] == "0" and rows["p1"]["超声结论"] == "ok\n fine"
    assert rows["late_age"]["sex"] == "男"
    assert str(rows["p1"]["test_date"]) == "2024-05-01"


def test_equal_ids_stay_separate_rows(spark):
    from recordlab.operators.wide import wide_table

    docs = [({"患者编号": "p", "检验": [item("a", str(i))]},) for i in range(3)]
    lines = spark.createDataFrame([(json.dumps(d[0]),) for d in docs], "value STRING")
    got = wide_table(rec.project_records(rec.parse_documents(lines)))
    assert sorted(r["a"] for r in got.collect()) == ["0", "1", "2"]


def test_written_corpus_keeps_line_order(spark, dirs, tmp_path):
    out = curate(spark, dirs, LABELS, out=str(tmp_path))
    text = {r["line_no"]: r["text"] for r in io.read_corpus(spark, f"{tmp_path}/corpus").collect()}
    label = {r["line_no"]: r["label"] for r in io.read_labels(spark, f"{tmp_path}/corpus/labels").collect()}
    keys = {r["line_no"]: r["text"] for r in io.read_lines(spark, f"{tmp_path}/corpus/keys").collect()}
    want = {r["rec_id"]: (r["text"], r["label"]) for r in out["corpus"].collect()}
    assert {keys[i]: (text[i], label[i]) for i in text} == want


def test_class_without_label_is_an_error(spark, dirs):
    with pytest.raises(ValueError):
        rec.read_records(spark, dirs, {"one": 1})


def test_missing_directory_is_an_error(spark, dirs):
    with pytest.raises(Exception):
        rec.read_records(spark, {"one": dirs["one"] + "_none"}, {"one": 1}).count()


def test_all_marker_with_other_marker_value(spark):
    from recordlab.operators.quality import drop_all_marker

    df = rec.project_records(rec.parse_documents(spark.createDataFrame([(json.dumps({"检验": [item("a", 9)]}),)], "value STRING")))
    assert drop_all_marker(df).count() == 1 and drop_all_marker(df, 9).count() == 0
    assert valid_stats(keep_nonempty(df), 9).first()["n_valid"] == 0


def test_stream_equals_batch_and_continues(spark, tmp_path):
    docs = [d for d in FILES.values() if isinstance(d, dict)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(json.dumps(d) for d in docs[:5]) + "\n{broken\n")

    def run():
        start_filter(read_record_stream(spark, str(source), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(str(r["rec_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    (source / "b.jsonl").write_text("\n".join(json.dumps(d) for d in docs[5:]))
    assert len(first) < len(run())
    assert run() == sorted(["p1", "p6", "None"])


def test_clean_table_end_to_end(spark):
    rows = []
    for i in range(40):
        rows.append(
            (i, f"f-{i}.json", "男" if i % 2 else "女", str(i) if i % 7 else " ", "7", f"note {i}", "1e9" if i == 3 else str(i * 2), "阳性" if i % 3 else None, None if i % 2 else "5.5" if i % 4 else "2")
        )
    df = spark.createDataFrame(rows, "rec_id INT, `文件名` STRING, `性别` STRING, a STRING, const STRING, `超声结论` STRING, b STRING, yin STRING, half STRING")
    got = clean_table(df)
    assert got.dropped == ["const", "half", "yin"]
    assert got.table.columns == ["rec_id", "文件名", "性别", "a", "b"]
    out = {r["rec_id"]: r for r in got.table.collect()}
    assert len(out) == 40 and out[1]["性别"] == 1.0 and out[5]["文件名"] == "f-5.json"
    assert out[3]["b"] < 80  # the outlier was cleared and imputed
    assert all(r["a"] is not None for r in out.values())


def test_clean_table_learns_from_training_rows_only(spark):
    rows = [(i, float(i % 10), float(i % 10) if i % 5 else None, i < 30) for i in range(40)]
    schema = "rec_id INT, a DOUBLE, b DOUBLE, train BOOLEAN"
    first = clean_table(spark.createDataFrame(rows, schema), key=("rec_id", "train"), fit_where=F.col("train"))
    moved = [(i, a, None if b is None else b + (0 if t else 3), t) for i, a, b, t in rows]
    second = clean_table(spark.createDataFrame(moved, schema), key=("rec_id", "train"), fit_where=F.col("train"))
    pick = lambda c: sorted(map(tuple, c.table.where("train").collect()))
    assert pick(first) == pick(second)


def test_filters_read_the_json_once(spark):
    docs = spark.createDataFrame([('{"患者编号":"1","检验":[{"项目名称":"a","结果":1,"年龄":"30"}]}',)], "value STRING")
    kept = quality_stages(rec.project_records(rec.parse_documents(docs)))[1]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"$['{rec.LAB_KEY}']") == 1
    assert [r["rec_id"] for r in kept.collect()] == ["1"]


def test_spelling_of_results(spark):
    results = ["5.0", "0", "12", "true", "null", '"5.0"', '"-0"', "12345678901234567890", '{"a":1}']
    for given in (results, ["12", '"x"', "null"], ["-7.0"]):
        items = ",".join(f'{{"结果":{r}}}' for r in given)
        docs = spark.createDataFrame([(f'{{"检验":[{items}]}}',)], "value STRING")
        labs = rec.project_records(rec.parse_documents(docs)).first()["labs"]
        want = [None if r == "null" else r.strip('"') if r.startswith('"') else r for r in given]
        assert [x["res_raw"] for x in labs] == want


def test_corpus_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return f"text {i}"

    rows = spark.range(50).select(F.col("id").cast("string").alias("rec_id"), (F.col("id") % 3).alias("label"), text("id").alias("text"))
    io.write_corpus(rows, str(tmp_path / "corpus"))
    assert made.value == 50
    assert io.read_corpus(spark, str(tmp_path / "corpus")).count() == 50
