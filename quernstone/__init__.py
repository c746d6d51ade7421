"""Spark-first retrieval, graph analytics and corpus processing over code repositories."""
