"""readloom: sequencing-alignment analytics expressed as Spark DataFrame jobs."""
