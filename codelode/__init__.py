"""codelode: indexing, search and analysis of text and source-code corpora on Spark DataFrames."""
