"""Training-data operators: ten corpus operators and the queries that register them."""
