"""DataFrame operators: joins, ordered calculations, aggregates, splits."""
