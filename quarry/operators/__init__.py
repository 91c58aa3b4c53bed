"""Operators: functions of facts and arguments that return DataFrames."""
