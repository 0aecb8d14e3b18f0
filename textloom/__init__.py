"""textloom: Spark jobs over multilingual document corpora."""
