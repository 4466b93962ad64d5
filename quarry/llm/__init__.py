"""Operators for large training-text corpora: language identification, quality scores and
rules, near and substring duplicates, page text, source mixing, token counts, personal data
and benchmark contamination.

Every operator takes DataFrames and column names, works on whole texts, and runs as Spark
jobs whose tasks use numpy on Arrow batches (``kernel``) or plain DataFrame functions.
``queries`` applies each to its table and derives the columns of the query's contract.
"""
