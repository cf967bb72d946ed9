"""An analytics engine on PySpark: DataFrame-to-DataFrame operators over multi-model data."""
