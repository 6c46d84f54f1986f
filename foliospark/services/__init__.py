"""Clients of external models. Operators take them as functions and run them on executors; offline nothing is called."""
