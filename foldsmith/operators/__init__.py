"""Joins, aggregations, encodings, ranks and folds over whole tables."""
