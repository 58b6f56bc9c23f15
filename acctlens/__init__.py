"""acctlens: account-360 analytics as PySpark DataFrame plans.

Public functions take DataFrames and parameters and return lazy DataFrames.
"""
