"""rolecall: job-posting analytics as PySpark DataFrame and streaming operators."""
