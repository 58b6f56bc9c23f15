"""Whole queries composed of operators: gold table, risk summary, insights, briefings, customer-system load."""
