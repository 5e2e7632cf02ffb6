"""Matching of candidate profiles to job postings, and corpus preparation, on Spark."""
