"""sparkloom: warehouse, profiling, text, vector and lineage operators as Spark DataFrame functions."""
