"""DataFrame operators: one concern per module, no actions inside unless stated."""
