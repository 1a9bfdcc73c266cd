"""A Spark-native engine for atlases of observations in many feature spaces."""
