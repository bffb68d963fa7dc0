"""Graph operators over DataFrames of edges."""
