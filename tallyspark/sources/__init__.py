"""Scans, sinks, snapshot tables, rule files and the business calendar."""
