"""Multi-step jobs put together from the operators."""
