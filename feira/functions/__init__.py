"""Part of the feira engine."""
