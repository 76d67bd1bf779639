"""takeoff: construction-cost analytics as Spark DataFrame operators."""
