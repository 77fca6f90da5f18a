"""The three sample plans on small made-up tables of the right shape."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabkit.plans import buildings, survey, weekly


@pytest.fixture(scope="module")
def answers(spark):
    rng = random.Random(5)
    names = [
        "h1n1_concern", "h1n1_knowledge", *survey.BEHAVIOUR, *survey.DOCTOR, *survey.OPINION, "household_adults",
        "household_children", *survey.CATEGORICAL, "sex", "rent_or_own",
    ]
    rows, labels = [], []
    for i in range(90):
        risk = rng.random()
        row = {"h1n1_concern": float(rng.randrange(4)), "h1n1_knowledge": float(rng.randrange(3))}
        row |= {c: float(rng.randrange(2)) for c in survey.BEHAVIOUR}
        row |= {c: float(rng.random() < risk) for c in survey.DOCTOR}
        row |= {c: float(1 + int(risk * 4.99)) for c in survey.OPINION}
        row |= {"household_adults": float(rng.randrange(4)), "household_children": float(rng.randrange(4))}
        row |= {c: rng.choice(["p", "q", "r"]) for c in survey.CATEGORICAL}
        row |= {"sex": rng.choice(["Female", "Male"]), "rent_or_own": rng.choice(["Own", "Rent"])}
        for c in names:
            if c != "sex" and rng.random() < 0.1:
                row[c] = None
        rows.append((i, *[row[c] for c in names]))
        labels.append((i, int(risk > 0.7), int(risk > 0.5)))
    text = {*survey.CATEGORICAL, "sex", "rent_or_own"}
    schema = "respondent_id long, " + ", ".join(f"{c} {'string' if c in text else 'double'}" for c in names)
    return (
        spark.createDataFrame(rows, schema),
        spark.createDataFrame(labels, "respondent_id long, h1n1_vaccine int, seasonal_vaccine int"),
    )


def test_survey(answers):
    features, labels = answers
    rows = survey.split(features, labels)
    model, best, results = survey.tune(rows, {"c": [1.0], "max_iter": [8]}, draws=1, folds=2)
    roc, auc = survey.evaluate(model, rows)
    found = {r["label"]: r["auc"] for r in auc.collect()}
    assert set(found) == set(survey.LABELS) and min(found.values()) > 0.7
    assert roc.filter("tpr < 0 or tpr > 1 or fpr < 0 or fpr > 1").count() == 0
    template = labels.select("respondent_id", F.lit(0.5).alias("h1n1_vaccine"), F.lit(0.7).alias("seasonal_vaccine"))
    assert survey.submission(model, features, template).count() == 90


def test_survey_exploration(answers):
    features, labels = answers
    described = survey.describe(features)
    texts = {"h1n1_concern_desc": "Concern?", "opinion_h1n1_risk_desc": "Risk?"}
    bars = survey.sentiment_layout(described, texts).groupBy("question").agg(F.sum("percentage").alias("s"))
    assert {r["question"]: r["s"] for r in bars.collect()} == pytest.approx({"Concern?": 100, "Risk?": 100})
    assert survey.label_shares(labels).groupBy("vaccine").agg(F.sum("count")).first()[1] == 90
    assert survey.population(features).agg(F.sum("counts")).first()[0] == features.dropna(subset=["age_group"]).count()


@pytest.fixture(scope="module")
def town(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(120):
        grade = rng.randrange(1, 4)
        rows.append((
            i, rng.randrange(31), rng.randrange(1428), rng.randrange(12568), rng.randrange(1, 60), rng.randrange(1, 30),
            rng.choice("nqx"), "r" if rng.random() < grade / 3 else "w", rng.choice("fvx"),
            int(grade > 1 and rng.random() < 0.9), rng.randrange(2),
        ))
        labels.append((i, grade))
    schema = (
        "building_id long, geo_level_1_id int, geo_level_2_id int, geo_level_3_id int, area_percentage int, "
        "height_percentage int, roof_type string, foundation_type string, ground_floor_type string, "
        "has_superstructure_mud_mortar_stone int, has_superstructure_timber int"
    )
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "building_id long, damage_grade int")


def test_buildings(town):
    values, labels = town
    rows = buildings.split(values, labels)
    model = buildings.tune(rows, n_trees=5, max_depth=4, min_leaf=[2, 5])
    assert 0.3 < buildings.micro_f1(model, rows).first()[0] <= 1
    names = {r["feature"] for r in buildings.importance(model, rows).collect()}
    assert names == {*buildings.NUMERIC, *[f"{c}_flag" for c in buildings.FLAGS]}
    out = buildings.submission(model, values, labels)
    assert out.columns == ["building_id", "damage_grade"] and out.count() == 120
    profile = buildings.damage_profile(values, labels, ["roof_type", "foundation_type"])
    assert profile.filter("feature = 'roof_type'").agg(F.sum("count")).first()[0] == 120


@pytest.fixture(scope="module")
def weeks(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for city, n in (("sj", 230), ("iq", 180)):
        for i in range(n):
            day = datetime.date(2000 + i // 52, 1, 1) + datetime.timedelta(days=7 * (i % 52))
            level = 10 + 8 * ((i % 52) / 52)
            measured = [None if 0 < i and rng.random() < 0.05 else level + rng.random() for _ in weekly.MEASUREMENTS]
            rows.append((city, 2000 + i // 52, i % 52 + 1, str(day), *measured))
            labels.append((city, 2000 + i // 52, i % 52 + 1, int(level * 3 + rng.random() * 5)))
    schema = "city string, year int, weekofyear int, week_start_date string, " + ", ".join(f"{c} double" for c in weekly.MEASUREMENTS)
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "city string, year int, weekofyear int, total_cases int")


def test_weekly_features(weeks):
    df = weekly.features(weekly.load(*weeks))
    assert df.count() == 410
    assert df.filter("lag1 is not null").count() > 0
    wanted = [f"{v}_trend" for v in weekly.TRENDS] + [f"{v}_seasonal" for v in weekly.SEASONALS]
    assert set(wanted) <= set(df.columns) and "ndvi_nw_seasonal" not in df.columns
    assert df.select([F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in [*wanted, *weekly.MEASUREMENTS]]).first().asDict() == {
        c: 0 for c in [*wanted, *weekly.MEASUREMENTS]
    }
    assert weekly.skew_report(weeks[0]).count() == 20
    assert "Average temperature station" in weekly.with_plain_names(weeks[0]).columns


def test_weekly_model(weeks):
    chosen = ["lag1", "lag2", "month", "month_sin", "reanalysis_avg_temp_k"]
    axes = {"stepSize": [0.5], "maxDepth": [2], "maxIter": [2]}
    predictions, errors, models = weekly.run(weekly.load(*weeks), axes, repeats=2, columns=chosen)
    assert sorted(models) == ["iq", "sj"]
    assert predictions.count() == 230 // 6 + 180 // 6
    assert all(r["rmse"] < 20 for r in errors.collect())
