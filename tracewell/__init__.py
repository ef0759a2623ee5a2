"""Audit analytics on Spark: facts of who changed what, where and when."""
