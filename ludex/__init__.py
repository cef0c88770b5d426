"""ludex — game-store analytics as Spark DataFrame jobs.

Layout:
  functions/  column expressions (cleaning rules, tokenising)
  sources/    readers and writers (JSON lines, literal lines, Parquet) and test-table bindings
  operators/  reusable DataFrame -> DataFrame operators (profiling, sentiment, recommender, joins)
  plans/      the derived-table jobs and the six questions, single and batch forms
"""

from ludex.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
