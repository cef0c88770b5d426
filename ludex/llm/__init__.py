"""Operators for preparing language-model training text. Nothing else in the package
imports this subpackage; its queries are listed in :mod:`ludex.llm.queries`."""
