"""Operators for training-data pipelines. Nothing else in mzframe imports this subpackage."""
