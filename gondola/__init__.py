"""gondola: shelf-price analytics and corpus preparation on Spark."""
