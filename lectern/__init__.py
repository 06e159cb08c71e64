"""A PySpark engine for question-bank analytics."""
