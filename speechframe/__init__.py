"""PySpark-native analytics over recordings, segments, speaker timelines and text corpora."""
