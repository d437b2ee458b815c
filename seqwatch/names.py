"""Fixed names, shapes and schemas of the sensor data.

Fixed values: topic, key, measurement, field and column names, sequence shape,
durations and size limits are part of the data format and must stay as they are.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import types as T

CHANNELS = ("set_t", "v_t")
STEPS = 20

WINDOW = timedelta(seconds=20)
SLIDE = timedelta(seconds=1)
WATERMARK = timedelta(seconds=5)
HISTORY = timedelta(days=2)

READINGS_TOPIC = "temperature_modbus"
DEMO_TOPIC = "temp_modbus_demo"
PREDICTIONS_TOPIC = "predictions"
DIAGNOSTICS_TOPIC = "stream_demo_pandas"
RECORD_KEY = "modb_temp"

MEASUREMENT = "kafka_consumer"
TIME_KEY = "event_timestamp"
STRING_FIELDS = ("window_start", "window_end", "isAnomaly")
MAX_MESSAGE_BYTES = 1_000_000
ARCHIVE_FLUSH = timedelta(seconds=10)

PAYLOAD_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType(), True) for c in CHANNELS]
)

HISTORY_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType(), False)]
    + [T.StructField(c, T.FloatType(), False) for c in CHANNELS]
)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), True),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("topic", T.StringType(), True),
        T.StructField("partition", T.IntegerType(), True),
        T.StructField("offset", T.LongType(), True),
        T.StructField("timestamp", T.TimestampType(), True),
    ]
)

POINT_SCHEMA = T.StructType(
    [
        T.StructField("measurement", T.StringType(), True),
        T.StructField("key", T.StringType(), True),
        T.StructField("_time", T.TimestampType(), True),
        T.StructField("_field", T.StringType(), True),
        T.StructField("_value", T.DoubleType(), True),
        T.StructField("_svalue", T.StringType(), True),
        T.StructField("_arrival", T.LongType(), True),
    ]
)
