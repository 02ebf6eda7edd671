"""A PySpark-native analytics engine: DataFrame functions over genomic, clinical and vector tables."""
