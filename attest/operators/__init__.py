"""Set-based operators: DataFrames in, DataFrame out."""
