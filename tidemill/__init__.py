"""tidemill: a PySpark library of order-safe table operators for text, event and relational batches."""
