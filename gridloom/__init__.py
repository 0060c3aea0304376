"""gridloom: a PySpark-native engine for gridded, meshed and tabular scientific data."""
