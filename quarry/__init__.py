"""quarry: a Spark-first analytics engine over lakehouse tables."""
