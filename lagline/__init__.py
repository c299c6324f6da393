"""lagline: Spark-native operators for predicting late departures from timestamped events."""
