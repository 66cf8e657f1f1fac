"""voxloom: a Spark-native analytics engine for speech and text corpora."""
