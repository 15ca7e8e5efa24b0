"""scoreline — match and ranking analytics as plain Spark DataFrame operators.

Layout:

* ``sources``   — reading tables (explicit schemas) and the match-shaped view
                  derived from the driver's order/line-item tables.
* ``functions`` — column expressions: exact half-up rounding, outcomes, points.
* ``operators`` — DataFrame -> DataFrame operators (overviews, rankings,
                  standings, streaks, head-to-head, snapshots, integrity).
* ``plans``     — the registered queries over the driver's tables and their
                  independent SQL formulations used as an oracle.
* ``streaming`` — the standings aggregate over a stream of match files.
"""

from scoreline.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
