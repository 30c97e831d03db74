"""Training-data operators: one module per operator, joined by ``queries``.

Nothing else in the library imports this subpackage.
"""
