"""Training, comparison and batch jobs put together from the operators."""
