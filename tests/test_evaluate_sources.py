from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tabkit.operators import evaluate as E
from tabkit.sources import tables as IO


def scored(spark, scores, truth):
    return spark.createDataFrame(list(zip(scores, truth)), "score double, truth int")


def pairwise_auc(scores, truth):
    pos = [s for s, t in zip(scores, truth) if t]
    neg = [s for s, t in zip(scores, truth) if not t]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("limit", [None, 3])
def test_auc(spark, limit):
    df = scored(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    assert E.roc_auc(df, [], max_rows=limit).first()["auc"] == 0.75
    ties = [round(0.1 * ((i * 7) % 11), 1) for i in range(60)]
    truth = [(i * 5) % 3 == 0 for i in range(60)]
    df = scored(spark, ties, [int(t) for t in truth])
    auc = E.roc_auc(df, [], max_rows=limit).first()["auc"]
    assert auc == pytest.approx(pairwise_auc(ties, truth))
    stretched = df.withColumn("score", F.exp("score") * 5 - 1)
    assert E.roc_auc(stretched, [], max_rows=limit).first()["auc"] == auc


@pytest.mark.parametrize("limit", [None, 2])
def test_roc_curve(spark, limit):
    df = scored(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    points = [(r["fpr"], r["tpr"], r["threshold"]) for r in E.roc_curve(df, [], max_rows=limit).orderBy(F.desc("threshold")).collect()]
    inf = float("inf")
    assert points == [(0, 0, inf), (0, 0.5, 0.8), (0.5, 0.5, 0.4), (0.5, 1, 0.35), (1, 1, 0.1)]
    straight = scored(spark, [0.9, 0.8, 0.7, 0.2, 0.1], [1, 1, 1, 0, 0])
    kept = E.roc_curve(straight, [], drop_collinear=True, max_rows=limit)
    assert sorted((r["fpr"], r["tpr"]) for r in kept.collect()) == [(0, 0), (0, 1), (1, 1)]


def test_multilabel(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 0, 1), (0, 0, 1, 0)], "a int, b int, pa int, pb int")
    row = E.multilabel_scores(df, {"a": ("a", "pa"), "b": ("b", "pb")}).first()
    assert tuple(row) == pytest.approx((1 / 3, 2 / 3, 2 / 3))


def test_class_metrics(spark, rows_of):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (3, 3)], "y int, p int")
    assert E.f1_micro(df, "y", "p").first()[0] == 0.75
    assert rows_of(E.confusion(df, "y", "p")) == [(1, 1, 1), (2, 2, 1), (3, 2, 1), (3, 3, 1)]
    report = {r["class"]: (r["support"], r["precision"], r["recall"], r["f1"]) for r in E.class_report(df, "y", "p").collect()}
    assert report[2] == (1, 0.5, 1.0, pytest.approx(2 / 3)) and report[3] == (2, 1.0, 0.5, pytest.approx(2 / 3))


def test_regression_metrics(spark):
    df = spark.createDataFrame([(0.0, 3.0), (10.0, 6.0)], "y double, p double")
    row = E.rmse_r2(df, "y", "p").first()
    assert row["rmse"] == pytest.approx(3.5355339059) and row["r2"] == pytest.approx(1 - 25 / 50)


SCHEMA = "id int, `a name` double, s string, d date"


def test_csv_roundtrip_and_null_spellings(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,a name,s,d\n1,1.5,"x, y",2001-02-03\n2,NaN,NA,\n3,,n/a,2001-01-01\n')
    df = IO.read_keyed_csv(spark, str(path), SCHEMA, ["id"])
    assert [tuple(r)[:3] for r in df.orderBy("id").collect()] == [(1, 1.5, "x, y"), (2, None, None), (3, None, None)]
    IO.write_csv(df, str(tmp_path / "out"), ["id"])
    assert IO.read_csv(spark, str(tmp_path / "out"), SCHEMA).exceptAll(df).count() == 0
    IO.write_csv(df, str(tmp_path / "bare"), ["id"], with_keys=False)
    assert spark.read.csv(str(tmp_path / "bare"), header=True).columns == ["a name", "s", "d"]


def test_repeated_keys_raise(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,v\n1,2\n1,3\n")
    with pytest.raises(ValueError, match="repeat"):
        IO.read_keyed_csv(spark, str(path), "id int, v int", ["id"])


def test_wrong_type_raises(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,v\nabc,2\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        IO.read_csv(spark, str(path), "id int, v int").collect()


def test_parquet(spark, tmp_path):
    df = spark.range(5)
    IO.write_table(df, str(tmp_path / "t"))
    assert IO.read_table(spark, str(tmp_path / "t")).count() == 5


def session_like(master, **conf):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_checkpoints_go_where_the_session_says(spark):
    from tabkit import session

    named = {"spark.checkpoint.dir": "/shared/checkpoints"}
    assert session.shared_folder(session_like("yarn", **named)) == "/shared/checkpoints"
    assert session.shared_folder(session_like("local[2]", **named)) == "/shared/checkpoints"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(session_like("yarn"))
    kept = session.stable(spark.range(3))
    assert kept.count() == 3 and all(session.run_folder(spark) in f for f in kept.inputFiles())


def test_broadcast_only_below_the_limit(spark):
    from tabkit.session import small_side

    big, small = spark.range(100), spark.range(10)
    hinted = big.join(small_side(small, 10), "id")
    assert "rightHint=(strategy=broadcast)" in hinted._jdf.queryExecution().optimizedPlan().toString()
    left_alone = big.join(small_side(small, 9), "id")
    assert "broadcast" not in left_alone._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_are_not_broadcast(spark):
    from tabkit.session import small_side

    wide = spark.range(10).withColumn("t", F.repeat(F.lit("x"), 1000))
    plan = spark.range(100).join(small_side(wide, 10, max_bytes=5000), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_null_predictions_count_as_wrong(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (0, 0)], "y int, p int")
    assert E.f1_micro(df, "y", "p").first()[0] == pytest.approx(2 / 3)
    row = E.multilabel_scores(df, {"a": ("y", "p")}).first()
    assert row["accuracy"] == pytest.approx(2 / 3) and row["recall_micro"] == 0.5


def test_r2_takes_rows_with_both_values(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 1.5), (100.0, None)], "y double, p double")
    row = E.rmse_r2(df, "y", "p").first()
    assert row["rmse"] == 0.5 and row["r2"] == 0.0


def test_roc_ignores_null_scores_and_other_labels(spark):
    df = spark.createDataFrame([(0.9, 2), (None, 0), (0.8, 1), (0.1, 0)], "score double, truth int")
    assert E.roc_auc(df, []).first()["auc"] == 1.0
    assert E.roc_curve(df, []).filter("threshold = double('infinity')").count() == 1
