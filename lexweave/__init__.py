"""lexweave: Spark-first analytics over structured legal text and register records."""
