"""riskloom: transaction-fraud analytics as composable Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL / DataFrame primitives so Catalyst can push
filters, prune columns and plan joins.  Sub-packages:

* ``sources``   - readers, sinks, model persistence, test-data fixtures
* ``functions`` - scalar column expressions (cleaning, dates, rules, scores)
* ``operators`` - schema helpers, cleaning, joins, aggregates, windows,
                  encoders, splits, metrics, ML fitting, scoring
* ``plans``     - end-to-end jobs (feature job, training, dashboard) and the
                  registry of named queries with their SQL oracles
* ``streaming`` - Structured Streaming scoring
"""

__version__ = "0.1.0"
