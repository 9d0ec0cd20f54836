"""Schemas of tables and files, never inferred."""

from pyspark.sql import types as T

_s = lambda *names: [T.StructField(n, T.StringType()) for n in names]

DIGEST = T.StructType([*_s("topic", "relevance", "digest"), T.StructField("speakers", T.ArrayType(T.StringType()))])
MUNICIPALITIES = T.StructType([*_s("code", "name", "prefecture", "base_url"), T.StructField("population", T.IntegerType()), T.StructField("population_year", T.IntegerType())])
MEETINGS = T.StructType(
    [
        *_s("id", "municipality_code", "title", "meeting_type"),
        T.StructField("held_on", T.DateType()),
        *_s("source_url", "external_id", "summary"),
        T.StructField("topic_digests", T.ArrayType(DIGEST)),
        T.StructField("summary_generated_at", T.TimestampNTZType()),
        *_s("summary_model"),
    ]
)
TOPICS = T.StructType([*_s("municipality_code", "canonical_name"), T.StructField("aliases", T.ArrayType(T.StringType(), False)), *_s("description")])
MEETING_TOPICS = T.StructType(_s("meeting_id", "municipality_code", "canonical_name", "relevance", "digest"))
MEETING_LINE = T.StructType(_s("id", "municipalityCode", "title", "meetingType", "heldOn", "sourceUrl", "externalId", "status", "scrapedAt"))
STATEMENT_LINE = T.StructType([*_s("id", "meetingId", "kind", "speakerName", "speakerRole", "content", "contentHash"), T.StructField("startOffset", T.IntegerType()), T.StructField("endOffset", T.IntegerType())])
SUMMARY_LINE = T.StructType([*_s("meetingId", "municipalityCode", "heldOn", "summary"), T.StructField("topicDigests", T.ArrayType(DIGEST)), *_s("summaryModel", "summaryGeneratedAt")])
MARKER = T.StructType([*_s("completedAt"), T.StructField("meetings", T.IntegerType()), T.StructField("statements", T.IntegerType()), T.StructField("imported", T.BooleanType()), *_s("importedAt"), T.StructField("summariesImported", T.BooleanType())])
CLUSTERS = T.StructType([T.StructField("clusters", T.ArrayType(T.StructType([*_s("canonical_name", "description"), T.StructField("member_indices", T.ArrayType(T.LongType()))])))])
SUMMARY_REPLY = T.StructType([*_s("summary"), T.StructField("topic_digests", T.ArrayType(DIGEST))])
USAGE = T.StructType([*_s("key"), T.StructField("ts", T.TimestampNTZType())])
