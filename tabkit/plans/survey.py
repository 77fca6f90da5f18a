"""Two-label survey classification, from raw answers to probabilities and ROC."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.scalars import log_grid, recode, yes_no
from tabkit.operators import evaluate as E
from tabkit.operators import prep as R
from tabkit.operators import profile as P
from tabkit.operators import score as Z
from tabkit.operators import split as L
from tabkit.operators import train as T
from tabkit.operators.columns import project
from tabkit.operators.joins import join_on

KEY = "respondent_id"

# The survey's column names, answer scales and their texts.
LABELS = ["h1n1_vaccine", "seasonal_vaccine"]
BEHAVIOUR = [
    "behavioral_antiviral_meds", "behavioral_avoidance", "behavioral_face_mask", "behavioral_large_gatherings",
    "behavioral_outside_home", "behavioral_touch_face", "behavioral_wash_hands",
]
DOCTOR = ["doctor_recc_h1n1", "doctor_recc_seasonal"]
OPINION = [
    "opinion_h1n1_risk", "opinion_h1n1_sick_from_vacc", "opinion_h1n1_vacc_effective", "opinion_seas_risk",
    "opinion_seas_sick_from_vacc", "opinion_seas_vacc_effective",
]
CATEGORICAL = [
    "age_group", "census_msa", "education", "employment_industry", "employment_occupation", "employment_status",
    "hhs_geo_region",
]
BINARY = ["rent_or_own", "sex"]
CHILDREN_TO_ANY = {0.0: 0.0, 1.0: 1.0, 2.0: 1.0, 3.0: 1.0}
KNOWLEDGE_TO_RATING = {0.0: 1.0, 1.0: 2.0, 2.0: 5.0}
CONCERN_TO_RATING = {0.0: 1.0, 1.0: 2.0, 2.0: 4.0, 3.0: 5.0}
CONCERN_TEXT = {0.0: "None", 1.0: "A little", 2.0: "Somewhat", 3.0: "A lot"}
KNOWLEDGE_TEXT = {0.0: "None", 1.0: "A little", 2.0: "A lot"}
OPINION_TEXT = {1.0: "None", 2.0: "A little", 3.0: "Dont know", 4.0: "Somewhat", 5.0: "A lot"}
ANSWER_CODES = {"None": -2, "A little": -1, "Dont know": 0, "Somewhat": 1, "A lot": 2}
SEARCH = {"c": log_grid(-1, 1, 10), "max_iter": [2500, 5000]}

NUMERIC = [*BEHAVIOUR, *DOCTOR, "household_adults", "household_child", "h1n1_conc", "h1n1_knwl", *OPINION]
ROLES = R.Roles(numeric=NUMERIC, categorical=CATEGORICAL, binary=BINARY)


def prepare(features: DataFrame) -> DataFrame:
    """Any child in the household, knowledge and concern on the scale of the other ratings; model columns only."""
    out = features.withColumns(
        {
            "household_child": recode(F.col("household_children"), CHILDREN_TO_ANY),
            "h1n1_knwl": recode(F.col("h1n1_knowledge"), KNOWLEDGE_TO_RATING),
            "h1n1_conc": recode(F.col("h1n1_concern"), CONCERN_TO_RATING),
        }
    )
    return project(out, [KEY, *NUMERIC, *CATEGORICAL, *BINARY])


def describe(features: DataFrame) -> DataFrame:
    """Answers as text: ratings with 'Dont know' for none given, flags as Yes / No / No response."""
    texts = {"h1n1_concern": CONCERN_TEXT, "h1n1_knowledge": KNOWLEDGE_TEXT} | {c: OPINION_TEXT for c in OPINION}
    out = {f"{c}_desc": recode(F.col(c), text, "Dont know") for c, text in texts.items()}
    out |= {f"{c}_desc": yes_no(F.col(c)) for c in [*BEHAVIOUR, *DOCTOR]}
    return features.withColumns(out)


def sentiment_layout(described: DataFrame, questions: dict[str, str]) -> DataFrame:
    """Diverging bars of the rating questions; `questions` gives each described column its text."""
    counts = P.question_responses(described, questions)
    coded = counts.withColumn("type_code", recode(F.col("type"), ANSWER_CODES))
    return P.diverging_layout(coded, "question", "type_code", "value")


def label_shares(labels: DataFrame) -> DataFrame:
    """Yes / No counts and percentages per vaccine."""
    shares = P.value_shares(labels, LABELS)
    return shares.select(
        F.when(F.col("value") == 1, "Yes").when(F.col("value") == 0, "No").alias("vaccinated"),
        "count", "percentage", F.col("feature").alias("vaccine"),
    )


def population(features: DataFrame) -> DataFrame:
    """Respondents by age group and sex."""
    counts = P.key_counts(features, ["age_group", "sex"], KEY)
    return counts.withColumnsRenamed({"age_group": "age", "sex": "gender"})


def estimator(n_rows: int, c: float = 1.0, max_iter: int = 100) -> Pipeline:
    return Pipeline(stages=[R.column_bundle(ROLES), *T.logistic_stages(LABELS, n_rows, c, max_iter)])


def split(features: DataFrame, labels: DataFrame, seed: int = 6) -> DataFrame:
    """Model rows with a train/test role, stratified by both labels together."""
    return L.stratified_split(join_on(prepare(features), labels, KEY), KEY, LABELS, 0.33, seed)


def tune(
    rows: DataFrame, axes: dict[str, list] | None = None, draws: int = 10, folds: int = 3, seed: int = 6
) -> tuple[PipelineModel, dict, list[dict]]:
    """Random search on the training rows, refitted on the best ROC AUC."""
    train = L.contiguous_folds(rows.filter(F.col("role") == "train"), [KEY], folds)
    scores = E.MacroAucEvaluator(LABELS).scores
    return T.random_search(train, estimator, axes or SEARCH, scores, "roc_auc", "fold", folds, draws, seed)


def evaluate(model: PipelineModel, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROC points and AUC per label on the test rows."""
    scored = model.transform(rows.filter(F.col("role") == "test"))
    wide = scored.select(*LABELS, *[Z.positive_probability(f"{n}_probability").alias(f"{n}_score") for n in LABELS])
    long = E.stack_labels(wide, {n: (n, f"{n}_score") for n in LABELS})
    return E.roc_curve(long, ["label"], drop_collinear=True), E.roc_auc(long, ["label"])


def submission(model: PipelineModel, features: DataFrame, template: DataFrame) -> DataFrame:
    """Probabilities for exactly the template's respondents."""
    scored = Z.score_probabilities(model, prepare(features), [KEY], LABELS)
    return Z.submission(scored, template, [KEY])
