"""Column functions: text, numbers, times, ids, document classes. No Python UDF."""
