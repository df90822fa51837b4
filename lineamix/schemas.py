"""Canonical schemas. Columns that were dynamic in files are rows here."""

from pyspark.sql import types as T

# Column names of the tools' files.
ABUNDANCE_FILE = "target_id string, tpm double"
CONSENSUS_FILE = "lineage string, scorpio_call string"
CLADE_FILE = "clade string, Nextclade_pango string, clade_who string"
CLADE_MAP_FILE = "clade string, pango string"
COMPOSITION_FILE = "lineage string, fraction double, sample string"
COUNTS_FILE = "date date, state string, clade string, sequences bigint"
PREDICTIONS_FILE = "sample string, prediction string, WHO_name string, fraction double, tool string"
SHEET_FILE = "sra string, primer string"

PREDICTIONS = T.StructType([
    T.StructField("sample", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("who_name", T.StringType()),
    T.StructField("fraction", T.DoubleType()),
    T.StructField("tool", T.StringType()),
])

PREDICTION_COLUMNS = PREDICTIONS.fieldNames()
