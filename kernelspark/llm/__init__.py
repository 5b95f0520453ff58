"""Corpus operators for training-data preparation, each a Spark job over whole tables.

Nothing else in the library imports this subpackage. General interfaces live in the
operator modules; ``queries`` registers one thin query per operator.
"""
