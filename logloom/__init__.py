"""Log-anomaly analytics on Spark: lines -> templates -> block features -> scores -> reports."""
