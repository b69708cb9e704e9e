"""strandloom: a Spark-native engine for genomic annotation and track-metadata analytics."""
