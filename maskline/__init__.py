"""maskline: personal-data detection, masking, audits and usage analytics as Spark DataFrame jobs."""
