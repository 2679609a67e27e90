"""One schema for cell tables, so nothing downstream asks which columns a file has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stainframe.functions.grading import finite

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

CELLS = T.StructType([
    T.StructField("cell_id", T.LongType()),
    T.StructField("centroid_x", T.DoubleType()),
    T.StructField("centroid_y", T.DoubleType()),
    T.StructField("is_center", T.BooleanType()),
    T.StructField("region", T.StringType()),
    T.StructField("area_um2", T.DoubleType()),
    T.StructField("solidity", T.DoubleType()),
    T.StructField("max_diameter_um", T.DoubleType()),
    T.StructField("min_diameter_um", T.DoubleType()),
    T.StructField("dab_mean", T.DoubleType()),
    T.StructField("membrane_ring_dab", T.DoubleType()),
    T.StructField("raw_membrane_dab", T.DoubleType()),
    T.StructField("membrane_completeness", T.DoubleType()),
    T.StructField("membrane_thickness_px", T.DoubleType()),
    T.StructField("membrane_thickness_um", T.DoubleType()),
    T.StructField("grade", T.ByteType()),
    T.StructField("grade_dab", T.ByteType()),
    T.StructField("grade_composite", T.ByteType()),
    T.StructField("thresholds_calibrated", T.BooleanType()),
])

# Columns the membrane measurement owns: replaced as a set.
MEASURED = ("dab_mean", "membrane_ring_dab", "raw_membrane_dab", "membrane_completeness", "membrane_thickness_px",
            "membrane_thickness_um", "grade_dab", "grade_composite", "thresholds_calibrated")

BASELINE = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "slide_name", "region", "total_cells", "negative", "weak_1plus", "moderate_2plus", "strong_3plus",
        "pct_positive", "h_score", "mean_dab_od")])

GEOJSON = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
    T.StructField("properties", T.StructType([
        T.StructField("classification", T.StructType([T.StructField("name", T.StringType())]))])),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])),
])))])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles mean unmeasured; null is how the rest of the library says so."""
    return df.withColumns({
        f.name: finite(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
