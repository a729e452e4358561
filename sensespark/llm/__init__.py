"""Training-data pipeline operators.

Each module holds one operator with a general interface; ``queries`` wires them
to the tables of the check.  Nothing outside this package imports it.
"""
