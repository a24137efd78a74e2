"""Names and types of the tables that operators exchange."""

from pyspark.sql import types as T

CELL = T.StructType([
    T.StructField("dataset_id", T.StringType()),
    T.StructField("row_key", T.StringType()),
    T.StructField("col", T.StringType()),
    T.StructField("v", T.DoubleType()),
])

PAIR = ["query_id", "target", "candidate_id"]

_before_after = T.ArrayType(T.DoubleType())
TRAINING_RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "query_dataset", "query_key", "target", "candidate_dataset", "candidate_key",
        "joined_dataset", "imputation_strategy", "mark")]
    + [T.StructField(n, _before_after) for n in (
        "mean_absolute_error", "mean_squared_error", "median_absolute_error", "r2_score")])

# The feature names of the metamodel, in the order of the feature files.
PROFILE_FEATURES = [
    "num_of_columns", "num_of_rows", "row_column_ratio", "max_mean",
    "max_outlier_percentage", "max_skewness", "max_kurtosis", "max_unique",
]
QUERY_FEATURES = ["query_" + f for f in PROFILE_FEATURES]
CANDIDATE_FEATURES = ["candidate_" + f.replace("num_of_rows", "num_rows") for f in PROFILE_FEATURES]
DATASET_FEATURES = QUERY_FEATURES + CANDIDATE_FEATURES
ASSOCIATION_FEATURES = ["max_pearson", "max_spearman", "max_covariance", "max_mutual_info"]
QUERY_TARGET_FEATURES = ["query_target_" + f for f in ASSOCIATION_FEATURES]
CANDIDATE_TARGET_FEATURES = ["candidate_target_" + f for f in ASSOCIATION_FEATURES]
PEARSON_DIFFERENCE = "max_pearson_difference"
CONTAINMENT = "containment_fraction"

ALL_FEATURES = (DATASET_FEATURES + QUERY_TARGET_FEATURES + CANDIDATE_TARGET_FEATURES
                + [PEARSON_DIFFERENCE, CONTAINMENT])
MODEL_FEATURES = [f for f in ALL_FEATURES if f != PEARSON_DIFFERENCE]
FREE_FEATURES = DATASET_FEATURES + QUERY_TARGET_FEATURES   # known without joining a candidate

RELATIVE_TARGETS = ["decrease_in_mae", "decrease_in_mse", "decrease_in_medae", "gain_in_r2_score"]

INSTANCE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("query", "target", "candidate")]
    + [T.StructField(n, T.DoubleType()) for n in ALL_FEATURES + RELATIVE_TARGETS]
    + [T.StructField(n, T.DoubleType()) for n in ("r2_score_before", "r2_score_after")])
