"""Dictionaries for the registered jobs, derived from the given tables."""


def demo_institutions(f):
    return f.institutions
