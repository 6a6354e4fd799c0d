"""Note analytics on Spark."""
