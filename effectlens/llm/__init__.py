"""Training-data operators: one module an operator, ``common`` for what they share.

Nothing outside this subpackage imports it.  Modules are imported on demand,
so that a worker loads only the operator it runs.
"""
