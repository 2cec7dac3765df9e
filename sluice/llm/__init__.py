"""Training-data operators: each module is one operator with a general interface.

``registry`` derives the registered queries from them. Nothing outside this
subpackage imports it.
"""
