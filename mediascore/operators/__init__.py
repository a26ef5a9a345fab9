"""DataFrame -> DataFrame operators: validation, features, fitting, trees, registry."""
