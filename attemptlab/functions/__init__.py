"""Column builders: every function takes and returns ``pyspark.sql.Column``."""
