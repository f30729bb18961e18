"""attemptlab: Spark-native analytics for graded programming attempts.

Operators are ``DataFrame -> DataFrame`` functions built from Spark SQL
expressions, windows, joins and aggregations.  Sub-packages:

* ``sources``   readers, sinks and the fixture views over the test tables
* ``functions`` ``Column`` builders (text parsing, tokens, vector maths)
* ``operators`` scenario derivation, grading, metrics, similarity, prompts,
                ratings, correlations and the testlet response model
* ``plans``     end-to-end flows that chain the operators
* ``streaming`` micro-batch ingestion of the submission log
"""

__version__ = "0.1.0"
