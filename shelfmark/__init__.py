"""Catalogue analytics on Spark: browse, search, ingest, jobs and trees as DataFrame operators."""
