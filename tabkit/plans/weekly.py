"""Weekly case counts per city: feature building, boosted regression, error table."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions import scalars as S
from tabkit.operators import evaluate as E
from tabkit.operators import explain as X
from tabkit.operators import impute as M
from tabkit.operators import prep as R
from tabkit.operators import score as Z
from tabkit.operators import series as W
from tabkit.operators import split as L
from tabkit.operators import stats as A
from tabkit.operators import train as T
from tabkit.operators.columns import apply_to, columns_except, rename
from tabkit.operators.joins import date_lags, join_on
from tabkit.session import stable

CITY, DATE, TARGET = "city", "date", "total_cases"
KEYS = ["city", "year", "weekofyear"]

# Plain names of the measurements, and which of them get which treatment.
PLAIN_NAMES = {
    "ndvi_ne": "Pixel northeast of city centroid",
    "ndvi_nw": "Pixel northwest of city centroid",
    "ndvi_se": "Pixel southeast of city centroid",
    "ndvi_sw": "Pixel southwest of city centroid",
    "precipitation_amt_mm": "Total precipitation station satellite",
    "reanalysis_air_temp_k": "Mean air temperature forecast",
    "reanalysis_avg_temp_k": "Average air temperature NCEP",
    "reanalysis_dew_point_temp_k": "Mean dew point temperature NCEP",
    "reanalysis_max_air_temp_k": "Maximum air temperature NCEP",
    "reanalysis_min_air_temp_k": "Minimum air temperature NCEP",
    "reanalysis_precip_amt_kg_per_m2": "Total precipitation kg_per_m2 NCEP",
    "reanalysis_relative_humidity_percent": "Mean relative humidity NCEP",
    "reanalysis_sat_precip_amt_mm": "Total precipitation mm NCEP",
    "reanalysis_specific_humidity_g_per_kg": "Mean specific humidity NCEP",
    "reanalysis_tdtr_k": "Diurnal temperature range forecast",
    "station_avg_temp_c": "Average temperature station",
    "station_diur_temp_rng_c": "Diurnal temperature range station",
    "station_max_temp_c": "Maximum temperature station",
    "station_min_temp_c": "Minimum temperature station",
    "station_precip_mm": "Total precipitation station station",
}
TO_KELVIN = ["station_avg_temp_c", "station_diur_temp_rng_c", "station_max_temp_c", "station_min_temp_c"]
TO_ROOT = ["ndvi_se", "ndvi_sw", "station_precip_mm"]
TO_RECIPROCAL = [
    "reanalysis_max_air_temp_k", "reanalysis_relative_humidity_percent", "reanalysis_tdtr_k", "station_diur_temp_rng_c",
]
TO_LOG = ["precipitation_amt_mm", "reanalysis_precip_amt_kg_per_m2", "reanalysis_sat_precip_amt_mm"]
TRENDS = [
    "ndvi_nw", "reanalysis_sat_precip_amt_mm", "reanalysis_specific_humidity_g_per_kg", "station_diur_temp_rng_c",
]
SEASONALS = [
    "reanalysis_avg_temp_k", "reanalysis_dew_point_temp_k", "reanalysis_min_air_temp_k", "reanalysis_sat_precip_amt_mm",
]
CYCLES = {"month": 12, "quarter": 4, "season": 4}
LAG_DAYS = {"lag1": 365, "lag2": 724, "lag3": 1096}
SEARCH = {"stepSize": [0.03, 0.05, 0.1], "maxDepth": [3, 7, 9], "maxIter": [500, 600]}
MEASUREMENTS = sorted(PLAIN_NAMES)


def load(features: DataFrame, labels: DataFrame) -> DataFrame:
    return join_on(features, labels, KEYS)


def with_plain_names(df: DataFrame) -> DataFrame:
    return rename(df, PLAIN_NAMES)


def skew_report(df: DataFrame) -> DataFrame:
    """Skewness of every measurement after the change of unit."""
    return A.skew_report(apply_to(df, TO_KELVIN, S.kelvin), MEASUREMENTS)


def features(df: DataFrame) -> DataFrame:
    """Units, normalising transforms, fills, calendar parts, trends, seasonal parts and lags.

    A city has one row per week, so its series is bounded by the calendar and
    all windows share one partitioning by city.
    """
    df = apply_to(df, TO_KELVIN, S.kelvin)
    df = apply_to(df, TO_ROOT, S.sqrt_abs)
    df = apply_to(df, TO_RECIPROCAL, S.reciprocal)
    df = apply_to(df, TO_LOG, S.log_positive)
    df = df.withColumn(DATE, S.parse_date(F.col("week_start_date")))
    df = M.forward_fill(df, [CITY], [DATE], MEASUREMENTS, max_rows=None)
    df = df.withColumns(S.date_parts(F.col(DATE)))
    for name, period in CYCLES.items():
        df = df.withColumns(S.cyclic(name, F.col(name), period))
    both = sorted({*TRENDS, *SEASONALS})
    df = W.decompose(df, [CITY], [DATE], both, 52, max_rows=None)
    unused = [f"{v}_{part}" for v in both for part in ("resid", "ok")]
    unused += [f"{v}_trend" for v in both if v not in TRENDS] + [f"{v}_seasonal" for v in both if v not in SEASONALS]
    df = df.drop(*unused, "week_start_date")
    return date_lags(df, DATE, TARGET, LAG_DAYS, [CITY])


def split(df: DataFrame) -> DataFrame:
    """Train/test role: the last of five expanding folds of each city is the test part."""
    return W.time_split(df, [CITY], [DATE], 5, max_rows=None)


def model_features(df: DataFrame) -> list[str]:
    return columns_except(df, [CITY, DATE, TARGET, "role"])


def stages(columns: list[str]) -> list:
    """Fill and flag nulls, scale to [0, 1], assemble, boost."""
    flags = R.NullFlags(columns)
    return [
        flags, R.MedianImputer(columns), R.MinMaxScale(columns),
        VectorAssembler(inputCols=[*columns, *flags.outputs()], outputCol="features", handleInvalid="error"),
        T.boosted_regressor(TARGET),
    ]


def fit_city(
    rows: DataFrame, columns: list[str], axes: dict[str, list] | None = None, repeats: int = 10
) -> tuple[Model, list[str]]:
    """Grid search with two time-ordered folds, again and again without the features of no importance."""
    train = L.contiguous_folds(rows, [DATE], 2, max_rows=None)

    def search(df: DataFrame, chosen: list[str]) -> Model:
        chain = stages(chosen)
        maps = T.param_maps(chain[-1], T.grid(**(axes or SEARCH)))
        r2 = RegressionEvaluator(labelCol=TARGET, metricName="r2")
        return T.grid_search(df, chain, maps, r2, "fold", 2).bestModel

    train = train.withColumn("row", F.unix_date(DATE))
    model, kept, _ = X.eliminate_features(train, columns, TARGET, "row", search, repeats)
    return model, kept


def predict(models: dict[str, Model], rows: DataFrame) -> DataFrame:
    """Whole-number predictions of every city's test weeks next to the true counts."""
    test = rows.filter(F.col("role") == "test")
    scored = None
    for city, model in models.items():
        part = Z.score_counts(model, test.filter(F.col(CITY).eqNullSafe(F.lit(city))), [CITY, DATE, TARGET])
        scored = part if scored is None else scored.unionByName(part)
    return E.prediction_table(scored, [CITY], DATE, "y_pred", TARGET)


def errors(predictions: DataFrame) -> DataFrame:
    return E.rmse_r2(predictions, TARGET, "y_pred", [CITY])


def run(
    df: DataFrame, axes: dict[str, list] | None = None, repeats: int = 10, columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame, dict[str, Model]]:
    """Predictions, errors and models of all cities of a joined table."""
    rows = stable(split(features(df)))
    chosen = columns or model_features(rows)
    models = T.fit_per_entity(
        rows.filter(F.col("role") == "train"), CITY, lambda part, _: fit_city(part, chosen, axes, repeats)[0]
    )
    predictions = predict(models, rows)
    return predictions, errors(predictions), models
