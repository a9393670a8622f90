"""Training-data operators: fixity, filtering, search, joins, packing and tokenisation on Spark."""
