"""Operators on media relations.

A *frame* row holds the time for which it is in force, half-open, so that retiming is a projection
and a lookup at a time is an interval test, never a search for the previous row:
``clip_id, t_us, e_us, dur_us`` and any payload columns.  A *sample* row is ``clip_id, i, ch, v``.
All times are whole microseconds of the clip; ``dur_us`` is the clip's duration, repeated in each
row, so that many clips of different lengths go through one plan without a join.
"""
