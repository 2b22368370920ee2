"""Daily-bar market analytics as pure DataFrame -> DataFrame functions on Spark."""
