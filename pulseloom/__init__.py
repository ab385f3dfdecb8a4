"""Spark-native analytics for physiological time series: recordings, beats, masks, intervals and rules as DataFrames."""
