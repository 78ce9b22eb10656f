"""netlens: network-log analytics as DataFrame -> DataFrame functions on Spark."""
