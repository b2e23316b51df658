"""Schemas of the log store. Timestamps are nanoseconds in a long: Spark's own timestamps hold microseconds only."""

from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())

PUSH_SCHEMA = T.StructType([
    T.StructField("streams", T.ArrayType(T.StructType([
        T.StructField("stream", LABELS),
        T.StructField("values", T.ArrayType(T.ArrayType(T.StringType()))),
    ]))),
])

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("line", T.StringType()),
    T.StructField("labels", LABELS),
    T.StructField("row_id", T.StringType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),  # flush or segment
    T.StructField("location", T.StringType()),  # local or remote
    T.StructField("local_path", T.StringType()),
    T.StructField("remote_url", T.StringType()),
    T.StructField("min_timestamp", T.LongType()),
    T.StructField("max_timestamp", T.LongType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("label_keys", T.ArrayType(T.StringType())),
    T.StructField("sealed_at", T.LongType()),
    T.StructField("uploaded_at", T.LongType()),
    T.StructField("trigrams", T.ArrayType(T.IntegerType())),  # null: must be scanned
    T.StructField("label_pairs", T.ArrayType(T.StringType())),  # null: must be scanned
])
