"""Table-to-table operators: each takes a DataFrame and returns one."""
