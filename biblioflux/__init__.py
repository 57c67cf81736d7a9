"""biblioflux: a PySpark-native engine for bibliographic record processing."""
