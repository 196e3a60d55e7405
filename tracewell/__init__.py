"""Forensic analytics over transaction-relay observations, written as Spark DataFrame jobs."""
