"""Registry of named queries: Spark plan + reference SQL side by side.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql | None)``.  Outputs are
normalised at the edge (decimal -> double, date -> timestamp) identically on
both sides so values compare exactly.
"""

from basketry.catalog.core import QUERIES, edge  # noqa: F401
from basketry.catalog import pages  # noqa: F401,E402
from basketry.catalog import models  # noqa: F401,E402
from basketry.catalog import finishing  # noqa: F401,E402
from basketry.catalog import quality  # noqa: F401,E402
from basketry.catalog import loading  # noqa: F401,E402
from basketry.catalog import report  # noqa: F401,E402
