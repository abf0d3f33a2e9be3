"""Training-data operators: ten scalable corpus tools, each in a module of its own.

Nothing outside this package imports it; ``queries`` holds the registered queries.
"""
