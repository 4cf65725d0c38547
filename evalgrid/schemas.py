"""Fixed schemas, declared once and passed to every reader (never inferred)."""

from pyspark.sql import types as T

ITEMS = T.StructType([
    T.StructField("split", T.StringType(), False),
    T.StructField("ord", T.LongType(), False),
    T.StructField("identifier", T.StringType(), True),
    T.StructField("id", T.StringType(), True),
    T.StructField("question", T.StringType(), False),
    T.StructField("options", T.StringType(), True),
    T.StructField("answer", T.StringType(), False),
])

RESPONSES = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("split", T.StringType(), False),
    T.StructField("shot", T.StringType(), False),
    T.StructField("identifier", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("cumulative_logprob", T.DoubleType(), True),
    T.StructField("token_ids", T.ArrayType(T.IntegerType()), True),
])

# generator output that numbers its requests instead of naming items
REQUEST_RESPONSES = T.StructType([T.StructField("request_id", T.LongType(), False), *RESPONSES.fields])

TUPLES = T.ArrayType(T.ArrayType(T.StringType()))

# ---- fixed values: field names of the benchmark's output files ----
DETAILS = T.StructType([
    T.StructField("identifier", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("options", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("pred_text", T.StringType()),
    T.StructField("pred_tuples", TUPLES),
    T.StructField("log_probability", T.DoubleType()),
    T.StructField("token_count", T.LongType()),
    T.StructField("match", T.BooleanType()),
    T.StructField("ord", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("shot", T.StringType()),
])

METRICS = ["accuracy", "precision", "recall", "f1", "bleu", "rouge1", "rouge2", "rougeL"]
SUMMARY_COLUMNS = ["timestamp", "dataset", "split", "model", "prompt_path", "task_type", *METRICS]
# ---- end fixed values ----
