"""Fixed schemas of parsed messages and files."""

from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType, TimestampType,
)

FILES = StructType(
    [
        StructField("path", StringType()), StructField("modificationTime", TimestampType()),
        StructField("length", LongType()), StructField("content", BinaryType()),
    ]
)

ATTACHMENT = StructType(
    [
        StructField("filename", StringType()), StructField("mime", StringType()), StructField("size", LongType()),
        StructField("content_id", StringType()), StructField("is_inline", BooleanType()), StructField("is_email", BooleanType()),
        StructField("sha256", StringType()), StructField("content", BinaryType()),
    ]
)

# One row per message of a file: node 0 is the file's own message, attached ones follow.
MESSAGE = StructType(
    [
        StructField("path", StringType()), StructField("node", IntegerType()), StructField("parent_node", IntegerType()), StructField("depth", IntegerType()),
        StructField("sibling", IntegerType()), StructField("display", StringType()), StructField("error", StringType()),
        StructField("message_id", StringType()), StructField("in_reply_to", StringType()), StructField("references", ArrayType(StringType())),
        StructField("from_addr", StringType()), StructField("to", ArrayType(StringType())), StructField("cc", ArrayType(StringType())),
        StructField("subject", StringType()), StructField("date_raw", StringType()), StructField("body_text", StringType()), StructField("body_html", StringType()),
        StructField("body_format", StringType()), StructField("conversation_index", StringType()), StructField("conversation_topic", StringType()),
        StructField("attachments", ArrayType(ATTACHMENT)), StructField("warnings", ArrayType(StringType())),
    ]
)
