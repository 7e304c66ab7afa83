"""A Spark-native relational analytics engine."""
