"""kvlake: analytics over a versioned key-value operation log, on Spark."""
