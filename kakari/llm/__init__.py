"""Training-data operators: each module holds one; nothing outside this subpackage imports it."""
