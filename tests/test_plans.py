"""The assessment as a whole, its history, sources and streams."""

import pytest
from pyspark.sql import functions as F

from tabgauge import Options, assess, metrics
from tabgauge.operators import validity
from tabgauge.plans import history, insights, report, summary
from tabgauge.sources import tables
from tabgauge.streaming import monitor


@pytest.fixture(scope="module")
def people(spark):
    made = spark.range(200).select(
        "id",
        F.when(F.col("id") < 120, F.lit(None)).otherwise(F.col("id") * 1.0).alias("income"),
        F.when(F.col("id") % 4 == 0, "12").otherwise("abc").alias("code"),
        F.concat(F.lit("p"), F.col("id"), F.when(F.col("id") < 60, " at x").otherwise("@x.example")).alias("email"),
        F.date_format(F.date_sub(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") * 5), "yyyy-MM-dd").alias("seen"),
    )
    return made


OPTIONS = Options(as_of="2024-02-01", rules={"people": {"positive": "id > 0"}}, combinations=[["id", "code"]])


@pytest.fixture(scope="module")
def result(people):
    return assess({"people": people}, OPTIONS)


def test_overall_is_mean_of_dimensions(result):
    scores = {r["dimension"]: r["score"] for r in summary.overall_scores(result).collect()}
    parts = [v for k, v in scores.items() if k != "overall"]
    assert len(parts) == 6 and scores["overall"] == pytest.approx(sum(parts) / 6)


def test_issues_in_order_of_severity(result):
    found = summary.top_issues(result).collect()
    assert [(r["column"], r["dimension"]) for r in found] == [("income", "Completeness"), ("code", "Consistency")]
    assert found[0]["issue"] == "Missing data (60.0%)" and found[0]["severity"] == pytest.approx(6)
    assert [r["column"] for r in summary.table_issues(result).collect()] == ["income", "code"]


def test_insights_and_gains(result):
    ranked = insights.prioritized(insights.insights(insights.signals(result)))
    found = {(r["rule"], r["column"]): r for r in ranked.collect()}
    missing = found["missing_values", "income"]
    assert (missing["priority"], missing["business_impact"]) == ("critical", 0.9)
    assert missing["improved_metrics"] == {"completeness_score": 20.0, "overall_quality": 10.0}
    assert missing["priority_score"] == pytest.approx(0.6 * 0.9 + 0.3 * 0.5 + 0.1 * 0.9)
    assert found["format_violations", "email"]["priority"] == "critical"
    assert found["business_rules", "positive"]["p"] == pytest.approx(0.5)
    improved = insights.improvements(ranked, summary.overall_scores(result)).collect()
    assert all(r["projected"] <= 100 for r in improved)
    focused = insights.prioritized(insights.insights(insights.signals(result)), "validity")
    score = focused.where("rule = 'format_violations'").first()["priority_score"]
    assert score == pytest.approx(0.5 * 0.8 + 0.2 * 0.5 + 0.3 * 1.0)
    assert insights.executive_summary(ranked, insights.improvements(ranked, summary.overall_scores(result))).count() > 3


def test_rearranging_rows_changes_nothing(people, result):
    again = assess({"people": people.orderBy(F.rand(1)).repartition(5)}, OPTIONS)
    names = ["table", "column", "metric"]

    def rounded(found):
        cells = metrics(found).withColumn("value", F.round("value", 6))
        return {tuple(str(r[n]) for n in names): r["value"] for r in cells.collect()}

    assert rounded(again) == rounded(result)


def test_subsets(people):
    only = assess({"people": people}, Options(dimensions=("completeness", "validity"), columns=["email", "nothing"]))
    assert [r["column"] for r in only.columns.collect()] == ["email"]
    assert {r["dimension"] for r in summary.dimension_scores(only).collect()} == {"completeness", "validity"}


def test_combinations(result):
    row = result.combinations.first()
    assert row["columns"] == ["id", "code"] and row["overall"] == pytest.approx(70 + 0.3 * 50)


def test_report_and_narrative(result):
    sections = {r["section"] for r in report.report(result).collect()}
    assert {"size", "summary", "scores", "completeness", "consistency_types", "keys", "timeliness", "validity"} <= sections
    assert report.narrative(result).count() == 3


def test_history(spark, result, tmp_path):
    path = str(tmp_path / "history")
    for day in range(1, 13):
        history.append(history.snapshot(result, "people", f"2024-01-{day:02d}"), path)
    kept = history.read(spark, path)
    assert history.latest(kept).count() == 10
    changes = history.score_change(kept).collect()
    assert sum(r["change"] is None for r in changes) == 1
    assert history.biggest_changes(kept).count() == 0
    assert kept.first()["top_issues"][0]["column"] == "income"


def test_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('name,age,score,member,day,empty\n"A, B",30,1.5,True,2024-01-01,\nC,NA,2,False,2024-01-02,\n"D ""x""",31,n/a,True,2024-01-03,\n')
    df = tables.load_table(spark, str(path))
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "score": "double", "member": "boolean", "day": "string", "empty": "double"}
    found = df.orderBy("day").collect()
    assert found[0]["name"] == "A, B" and found[1]["age"] is None and found[2]["name"] == 'D "x"'
    with pytest.raises(ValueError):
        tables.load_table(spark, "people.xyz")


@pytest.mark.parametrize("ending", ["parquet", "json", "orc", "csv"])
def test_write_and_read_back(spark, people, tmp_path, ending):
    path = str(tmp_path / f"people.{ending}")
    tables.write_table(people, path)
    assert tables.load_tables(spark, str(tmp_path))["people"].count() == 200


def test_watch_appends_a_snapshot_per_batch(spark, people, tmp_path):
    people.limit(100).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.file_stream(spark, str(tmp_path / "in"), people)
    query = monitor.watch(
        stream, "people", str(tmp_path / "history"), str(tmp_path / "state"), Options(as_of="2024-02-01")
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "history")).first()["total_rows"] == 100


def test_one_history_of_batches_and_snapshots(spark, people, result, tmp_path):
    path = str(tmp_path / "history")
    history.append(history.snapshot(result, "single", "2024-02-01"), path)
    for _ in range(2):  # a batch that runs again replaces its own snapshot
        history.put_batch(history.snapshot(result, "batch", "2024-02-02"), path, "people-0")
    history.put_batch(history.snapshot(result, "batch", "2024-02-03"), path, "people-1")
    history.put_batch(history.snapshot(result, "batch", "2024-02-04"), path, "people-1")
    found = history.read(spark, path).orderBy("ts").collect()
    assert [(r["name"], str(r["day"])) for r in found] == [
        ("single", "2024-02-01"), ("batch", "2024-02-02"), ("batch", "2024-02-04")
    ]
    assert len(history.score_change(history.read(spark, path)).collect()) == 3


def test_insight_wording_can_be_followed(result):
    rules = {rule.name: rule for rule in insights.RULES}
    assert rules["value_ranges"].scale == 100 and rules["outliers"].scale == 1
    assert "''" not in rules["outdated_records"].example


def test_infinity_does_not_stop_an_assessment(spark):
    rows = [(float("inf"), "a"), (1.0, "b"), (2.0, "c")] + [(3.0, "d")] * 20
    found = metrics(assess({"t": spark.createDataFrame(rows, "x double, y string")}))
    assert found.where("column = 'x' AND metric = 'median'").first()["value"] == 3.0


def test_checkpoint_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from tabgauge.functions import checkpoints

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.use_checkpoint_dir(Session())


def test_quotes_over_several_lines_are_counted(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines"\n2,plain\n')
    assert tables.broken_quotes(spark, str(path)) == 2
    assert tables.load_table(spark, str(path), multiline=True).count() == 2


@pytest.mark.parametrize("sep", [",", "|"])
def test_quotes_over_several_lines_are_refused(spark, tmp_path, sep):
    path, plain = tmp_path / "notes.csv", tmp_path / "plain.csv"
    path.write_text('id,note\n1, "two\nlines, ""so"""\n2,plain\n'.replace(",", sep))
    with pytest.raises(ValueError, match="multiline=True"):
        tables.load_table(spark, str(path), sep=sep)
    assert tables.load_table(spark, str(path), sep=sep, multiline=True).count() >= 2
    plain.write_text('id,note\n1,5" pipe\n2,"a ""word"""\n'.replace(",", sep))
    assert [r["note"] for r in tables.load_table(spark, str(plain), sep=sep).collect()] == ['5" pipe', 'a "word"']


def test_metrics_have_rules_and_combinations(result):
    found = {(r["dimension"], r["column"], r["metric"]): r["value"] for r in metrics(result).collect()}
    assert found["rules", "positive", "violations"] == 1
    assert found["combinations", "id + code", "completeness"] == 100


def test_own_checks(spark):
    df = spark.createDataFrame([("DE-1",), ("x",)], "plate string")
    checks = validity.Checks(formats=(("plate", ("plate",), r"^[A-Z]{2}-\d+$"),), ranges=())
    assert validity.validity_columns(df, checks).first()["valid_count"] == 1
