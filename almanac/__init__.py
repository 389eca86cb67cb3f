"""Almanac: a PySpark engine for event listings harvested from web pages."""
