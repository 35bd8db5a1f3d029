"""Operators for building training data: twelve of them, one module each.

Nothing else in the library imports this subpackage.  ``queries`` holds the registered
queries and their SQL; ``textops`` holds the byte-level text routines that several
operators share; ``components`` finds connected components.
"""
