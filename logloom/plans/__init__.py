"""The queries a user runs, composed from the operators."""
