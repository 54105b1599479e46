"""Domain operators: functions from DataFrames to DataFrames."""
