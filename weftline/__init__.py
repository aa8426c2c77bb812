"""weftline: a PySpark-native text analytics engine."""
