"""Governed credit-risk analytics on Spark."""
