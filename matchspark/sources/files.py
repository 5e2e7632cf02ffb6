"""Files that people keep: vocabulary, block list, parsed résumés."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.schema import RESUME


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """term, category, reason of a CSV with a header; blank terms go."""
    rows = spark.read.schema("term string, category string, reason string").csv(path, header=True, multiLine=True, escape='"')
    return rows.select(*(F.trim(c).alias(c) for c in rows.columns)).where("coalesce(term, '') <> ''")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """skill_id, name, aliases, active of a CSV with columns skill_id, name, aliases (``|`` between), active."""
    rows = spark.read.schema("skill_id string, name string, aliases string, active boolean").csv(path, header=True)
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.trim("skill_id").alias("skill_id"), F.trim("name").alias("name"), aliases.alias("aliases"), F.coalesce("active", F.lit(True)).alias("active")).where("coalesce(name, '') <> ''")


def read_resumes(raw: DataFrame, id_col: str = "resume_id", payload: str = "payload") -> DataFrame:
    """resume_id, parsed and corrupt (the text of a payload that is no résumé)."""
    schema = T.StructType([*RESUME.fields, T.StructField("corrupt", T.StringType())])
    rows = raw.select(F.col(id_col).alias("resume_id"), F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("p"))
    parsed = F.struct(*(F.col(f"p.{f.name}").alias(f.name) for f in RESUME.fields))
    return rows.select("resume_id", F.when(F.col("p.corrupt").isNull(), parsed).alias("parsed"), F.col("p.corrupt").alias("corrupt"))
