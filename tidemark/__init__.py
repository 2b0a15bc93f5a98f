"""tidemark: versioned, branchable analytics tables as plain Spark DataFrames."""
