"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("content", T.StringType()),
    ]
)

# Raw input of the directory source: content still undecoded.
RAW_FILES = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("content", T.BinaryType()),
    ]
)

FINDING = (
    "struct<rule_id:string,type:string,message:string,line:int,col:int,position:int,"
    "level:string,severity:string>"
)
COUNT = "struct<rule_id:string,type:string,severity:string,level:string,n:int>"
PATTERN_HIT = "struct<rule_id:string,pattern:string,position:int,line:int,context:string>"
EMPTY_FINDINGS = f"cast(array() as array<{FINDING}>)"
EMPTY_COUNTS = f"cast(array() as array<{COUNT}>)"
EMPTY_PATTERNS = f"cast(array() as array<{PATTERN_HIT}>)"

KEY = ["project", "path"]
