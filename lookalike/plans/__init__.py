"""File operations in two steps: a plan as a DataFrame (op, src, dest, reason, status), and its execution."""
