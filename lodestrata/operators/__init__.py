"""Operators over DataFrames: aggregates, retrieval, chunking, rules, evaluation."""
