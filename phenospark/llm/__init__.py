"""Operators for large-scale training-data pipelines (one module each).

Nothing else in the library imports this subpackage.  Shared rules:

* ``docs`` tables have ``doc_id`` and ``text``; further columns are allowed and
  never clash with an operator's own, because each operator first takes the
  columns it needs under its own names.
* A null text is an empty text.  A null ``doc_id`` is one ordinary id that sorts
  after all others.  Repeated rows are separate rows.
* Intermediate tables and files go to the shared folder that the session names
  in ``spark.checkpoint.dir`` (:mod:`phenospark.llm.common`).
"""
