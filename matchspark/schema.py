"""Schemas of the job, résumé and match tables."""

from __future__ import annotations

from pyspark.sql import types as T

RESUME = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("total_experience_years", T.DoubleType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("projects", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("tech", T.ArrayType(T.StringType()))]))),
    T.StructField("experience", T.ArrayType(T.StructType([T.StructField("company", T.StringType()), T.StructField("role", T.StringType()), T.StructField("duration", T.StringType())]))),
    T.StructField("education", T.ArrayType(T.StructType([T.StructField("institution", T.StringType()), T.StructField("degree", T.StringType()), T.StructField("year", T.StringType())]))),
])

#: Columns of a normalised posting, in order.
JOB_COLUMNS = {
    "source": "string", "source_job_id": "string", "title": "string", "company": "string", "location": "string", "is_remote": "boolean",
    "description": "string", "apply_url": "string", "salary_raw": "string", "salary_min": "decimal(14,2)", "salary_max": "decimal(14,2)",
    "salary_currency": "string", "salary_period": "string", "experience_raw": "string", "experience_min_years": "decimal(4,1)", "posted_date": "date",
}

#: Columns that an upsert refreshes, nulls included.
REFRESHED = [c for c in JOB_COLUMNS if c not in ("source", "source_job_id")] + ["dedup_hash", "fetched_at"]
