"""Automation-metadata and change-data-capture analytics as declarative Spark plans."""
