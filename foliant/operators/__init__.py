"""Relational operators: each adds named steps to a plan, for any number of workspaces and questions at once."""
