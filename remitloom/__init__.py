"""remitloom: a PySpark-native analytics engine for bank-transfer data."""
