"""Customer-retention analytics on Spark: DataFrame operators, plans and streams."""
