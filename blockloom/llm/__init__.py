"""Operators that prepare text corpora for model training, each one a Spark job."""
