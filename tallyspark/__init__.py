"""tallyspark: receipt, revenue, refund and forecast analytics as Spark DataFrame functions."""
