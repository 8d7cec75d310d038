"""Retail pipeline on Spark: raw strings -> trusted table -> star schema -> checks and reports."""
