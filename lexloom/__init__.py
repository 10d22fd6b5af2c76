"""lexloom: phrase mining, open information extraction and corpus preparation on PySpark."""
