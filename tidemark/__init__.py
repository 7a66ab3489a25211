"""Tidemark: interval, selection and relational analytics written as Spark DataFrame plans."""
