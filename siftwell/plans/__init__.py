"""Retrieval plans, evaluation runs and their records."""
