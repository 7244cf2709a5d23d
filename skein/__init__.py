"""Text search and recommendation over catalogues, on DataFrames."""
