"""Document analytics on Spark: routing, extraction, structuring, personal-data masking,
comparison, batch reporting and a tamper-evident audit chain, expressed as DataFrame plans."""

__version__ = "0.1.0"
