"""fieldloom: a Spark-native engine for reconstructing spatio-temporal fields from sparse ordinal records."""
