"""Point-in-time risk features and back-tests for insurance tables, as Spark jobs.

Layers, from the bottom up:

* ``functions``  column expressions, no joins and no shuffles
* ``sources``    readers and writers
* ``operators``  DataFrame -> DataFrame building blocks (as-of joins, retro windows, ranks)
* ``plans``      whole jobs built from the operators
"""

COVERAGES = ("DC", "COMPSP", "APCOLL", "TPL", "AB")

SESSION_KEYS = (
    "policy_num", "vin", "dln", "term_eff", "term_days", "ver_eff", "ver_exp", "ver_days",
)
EVENT_KEYS = ("policy_num", "vin", "dln", "ver_eff")
TRIPLET = ("vin", "dln", "policy_num")
