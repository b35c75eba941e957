"""Relational operators: each module is one family of lazy DataFrame builders."""
