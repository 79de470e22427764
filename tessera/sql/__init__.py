"""The SQL front end: text to statements, and queries to Spark SQL."""
