"""Operators of a training-data pipeline over whole tables of documents, conversations and vectors.

Each module holds one operator with its own general interface; ``queries.py`` registers one query
per operator. Nothing outside this folder imports it (``__spark_entry__.py`` adds its queries when
it can be imported).
"""
