"""Exact-money observation ledger on PySpark."""
