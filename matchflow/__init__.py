"""Job-posting and candidate-matching analytics as DataFrame -> DataFrame operators on Spark."""
