"""Operators that prepare a text collection for training.

One module per operator; ``entries`` has their queries and oracle SQL.
"""
