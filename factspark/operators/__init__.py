"""Rules, pull, and index access."""
