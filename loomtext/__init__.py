"""loomtext: training-text preparation as Spark DataFrame jobs."""
