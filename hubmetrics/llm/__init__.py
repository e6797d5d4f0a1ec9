"""Operators of a training-data pipeline: ten operators, their queries and the SQL some of them must agree with."""
