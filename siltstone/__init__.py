"""siltstone: a text-retrieval engine whose documents, postings, statistics and rankings are Spark DataFrames."""
