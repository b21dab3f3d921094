"""Operators put together: access rows, reports, model training and the whole batch run."""
