"""gleaner: a PySpark-native analytics engine for large collections of text postings."""
