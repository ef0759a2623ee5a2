"""Structured Streaming forms of the ingest and attribution operators.

All of them see events in arrival order, sort what arrives together by (ts,
id), and so equal their batch forms as long as nothing arrives late.
"""
