"""Asset-corpus analytics as Spark DataFrame operators."""
