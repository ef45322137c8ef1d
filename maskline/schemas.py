"""Explicit schemas of the sources: nothing is inferred."""

from pyspark.sql import types as T

ENTITY = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()),
])
ANNOTATED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(ENTITY)),
    T.StructField("_corrupt_record", T.StringType()),
])
ALIASES = T.StructType([
    T.StructField("alias", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("price_in", T.DecimalType(20, 12)), T.StructField("price_out", T.DecimalType(20, 12)),
    T.StructField("price_query", T.DecimalType(20, 12)),
])
TEAM = T.StructType([
    T.StructField("team_id", T.StringType()), T.StructField("team_alias", T.StringType()),
    T.StructField("models", T.ArrayType(T.StringType())), T.StructField("max_budget", T.DecimalType(18, 6)),
    T.StructField("budget_duration", T.StringType()), T.StructField("pii_masking", T.StringType()),
    T.StructField("key", T.StructType([
        T.StructField("key_alias", T.StringType()), T.StructField("rpm_limit", T.IntegerType()),
        T.StructField("tpm_limit", T.IntegerType()),
    ])),
])
MESSAGES = "struct<model:string,messages:array<struct<role:string,content:string>>>"
OBSERVATION = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("trace_id", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("team", T.StringType()), T.StructField("alias", T.StringType()),
    T.StructField("tokens_in", T.LongType()), T.StructField("tokens_out", T.LongType()),
    T.StructField("cost", T.DecimalType(30, 10)), T.StructField("latency", T.DoubleType()),
    T.StructField("level", T.StringType()), T.StructField("masked", T.MapType(T.StringType(), T.LongType())),
])
JOB_MESSAGE = T.StructType([
    T.StructField("message_id", T.LongType()), T.StructField("body", T.StringType()),
    T.StructField("reply_to", T.StringType()), T.StructField("delivery_count", T.IntegerType()),
    T.StructField("ts", T.TimestampType()), T.StructField("correlation_id", T.StringType()),
])
ATTEMPT = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("attempt_id", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("status", T.IntegerType()),
    T.StructField("reset_at", T.StringType()), T.StructField("retry_after", T.StringType()),
])
CALL = T.StructType([
    T.StructField("call_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("team", T.StringType()),
    T.StructField("alias", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("tokens_in", T.LongType()),
    T.StructField("tokens_out", T.LongType()), T.StructField("cost", T.DecimalType(30, 10)),
])
CHUNK = T.StructType([
    T.StructField("answer_id", T.LongType()), T.StructField("conv_id", T.LongType()),
    T.StructField("seq", T.IntegerType()), T.StructField("chunk", T.StringType()),
    T.StructField("is_last", T.BooleanType()), T.StructField("ts", T.TimestampType()),
])
