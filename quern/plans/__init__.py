"""Registered queries over the driver's tables, with SQL for comparison where SQL can state them."""
