"""Spark-native transaction analytics: causal features, evaluation, monitoring and audits over DataFrames."""
