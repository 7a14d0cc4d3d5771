"""Column expressions: every helper returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""
