"""Operators: DataFrame in, DataFrame out.  None collects rows to the driver."""
