"""Registered queries: each a DataFrame plan over the library's operators, with equivalent DuckDB SQL where there is one."""
