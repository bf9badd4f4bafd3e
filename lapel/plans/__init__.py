"""The registered queries with their parameters, and independent SQL for each."""
