"""Tables, exports and maintenance jobs."""
