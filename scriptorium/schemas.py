"""Explicit schemas of the pipeline zones (never inferred in production)."""

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField,
                               StructType)

AUTHORSHIP = StructType([StructField("author", StructType([
    StructField("id", StringType()), StructField("display_name", StringType())]))])

RAW_WORK = StructType([
    StructField("doi", StringType()),
    StructField("title", StringType()),
    StructField("authorships", ArrayType(AUTHORSHIP)),
    StructField("publication_year", IntegerType()),
    StructField("venue_name", StringType()),
    StructField("abstract_inverted_index", MapType(StringType(), ArrayType(IntegerType()))),
    StructField("cited_by_count", IntegerType()),
])

AUTHOR = StructType([StructField("name", StringType()), StructField("openalex_id", StringType())])

CLEAN_PAPER = StructType([
    StructField("seq", LongType()),
    StructField("doi", StringType()),
    StructField("title", StringType()),
    StructField("abstract", StringType()),
    StructField("authors_struct", ArrayType(AUTHOR)),
    StructField("year", IntegerType()),
    StructField("venue", StringType()),
    StructField("citation_count", IntegerType()),
    StructField("authors_text", StringType()),
])

RESULT = StructType(CLEAN_PAPER.fields + [
    StructField("cluster_id", IntegerType()),
    StructField("cluster_label", StringType()),
    StructField("predicted_multi_labels", ArrayType(StringType())),
    StructField("topic_keywords", ArrayType(StringType())),
    StructField("topic_distribution", ArrayType(DoubleType())),
])

ROSTER = StructType([StructField("name", StringType()), StructField("institution", StringType()),
                     StructField("faculty", StringType()), StructField("email", StringType())])
