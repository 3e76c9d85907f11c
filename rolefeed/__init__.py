"""Posting analytics on Spark: normalise, classify, de-duplicate and report career-site postings."""
