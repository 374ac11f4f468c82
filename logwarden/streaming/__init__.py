"""Rules and incidents over logs that are still being written."""
