"""Retail price intelligence as Spark DataFrame operators."""
