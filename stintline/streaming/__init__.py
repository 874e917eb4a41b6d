"""No streaming operator exists: the product being rebuilt is a weekly batch.

Its only incremental logic is ``operators.calendar.stale_rounds``, a batch join.
"""
