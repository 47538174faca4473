"""PySpark-native engine for collections of versioned JSON and tabular objects."""
