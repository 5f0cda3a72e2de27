"""An analytics engine for typed property graphs and the networks underneath them, on PySpark."""
