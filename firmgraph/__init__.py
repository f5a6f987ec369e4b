"""Company-intelligence operators for Spark."""
