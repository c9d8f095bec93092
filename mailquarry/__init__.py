"""mailquarry: a PySpark-native engine for searching and evaluating large text archives."""
