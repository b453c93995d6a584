"""PySpark-native analytics of time-ordered records and the text attached to them."""
