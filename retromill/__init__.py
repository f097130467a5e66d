"""Spark-native analytics for LTR retrotransposon families."""
