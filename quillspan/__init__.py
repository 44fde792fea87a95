"""quillspan: a Spark-native engine for legacy data languages, their lineage and the tables around them."""
