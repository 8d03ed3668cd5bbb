"""Sources: files and artifacts of books as DataFrames."""
