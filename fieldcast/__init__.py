"""Spark jobs for broadcast-market analytics: plain DataFrame in, DataFrame out."""
