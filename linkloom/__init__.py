"""linkloom: a Spark-native record-linkage engine for recordings, catalogues and schedules."""

__version__ = "0.1.0"
