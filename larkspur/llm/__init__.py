"""Operators over the texts of a training-data pipeline. Nothing outside this subpackage imports it."""
