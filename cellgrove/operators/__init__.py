"""Grid operators: functions from DataFrames to DataFrames."""
