"""Operators for a training-data pipeline (queries in ``llm.queries``)."""
