"""codexflow: a Spark-native bibliography analytics engine."""

__version__ = "0.1.0"
