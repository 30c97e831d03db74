"""The one logical row type, an entry, and its tagged values."""

from pyspark.sql import types as T

FIELD = T.StructType([
    T.StructField("Key", T.StringType(), False),
    T.StructField("StringValue", T.StringType()),
    T.StructField("LongValue", T.LongType()),
    T.StructField("DoubleValue", T.DoubleType()),
    T.StructField("BoolValue", T.BooleanType()),
])
ENTRY = T.StructType([
    T.StructField("Timestamp", T.TimestampType(), False),
    T.StructField("Level", T.StringType(), False),
    T.StructField("Message", T.StringType(), False),
    T.StructField("Source", T.StringType(), False),
    T.StructField("TemplateHash", T.LongType(), False),
    T.StructField("Fields", T.ArrayType(FIELD, False), False),
])
#: Which slot of a tagged value holds which type; a datetime is kept as text in ISO form.
SLOTS = {"string": "StringValue", "long": "LongValue", "double": "DoubleValue", "boolean": "BoolValue", "datetime": "StringValue"}
#: Stands for a timestamp that could not be read.
NO_TIMESTAMP = "0001-01-01 00:00:00"
UNKNOWN_LEVEL = "UNKNOWN"
