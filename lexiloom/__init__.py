"""lexiloom: leveled reference data, item checks and training-data operators on Spark."""

__version__ = "0.1.0"
