"""tidewater: ordered time-series analytics and corpus preparation on PySpark."""
