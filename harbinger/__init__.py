"""harbinger: early signals in public filings, on Spark."""
