"""textloom: a Spark engine for addressing, searching, outlining, editing and summarising text corpora."""
