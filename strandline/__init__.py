"""Time-series observations to operational models, and large-corpus operators, on PySpark."""
