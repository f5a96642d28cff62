"""graphsieve."""
