"""Graph and evaluation operators: every function takes and returns DataFrames."""
