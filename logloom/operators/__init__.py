"""DataFrame operators; each takes and returns DataFrames and adds no action of its own unless stated."""
