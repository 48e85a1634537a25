"""Governance of structured log telemetry on PySpark: sampling, redaction, accounting, streaming."""
