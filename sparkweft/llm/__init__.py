"""Training-data operators: one module per operator; nothing outside this subpackage imports it."""
