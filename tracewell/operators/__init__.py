"""DataFrame operators: joins, windows, aggregations over facts."""
