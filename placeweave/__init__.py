"""placeweave — business-listing extraction and enrichment as Spark table jobs.

Captured pages (``page_id, url, html``) and request tables go in; clean,
deduplicated, enriched business rows, quality checks and run metrics come out.
Every per-row rule is a native Column expression; the only Python-side map is
the HTML flattening job in :mod:`placeweave.operators.elements`.

Main entry points::

    from placeweave import get_spark, run, page_elements, listings, detail_fields
    from placeweave.functions import text        # C1–C15 column rules
    from placeweave.plans import metrics, quality, analyses
"""

import sys

from pyspark import cloudpickle

from placeweave.operators.details import detail_fields
from placeweave.operators.elements import page_elements
from placeweave.operators.listing import listings
from placeweave.plans.business_run import run
from placeweave.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir", "run", "page_elements", "listings", "detail_fields"]
__version__ = "0.1.0"

# Functions that run inside tasks travel with their code, so workers need no
# copy of the package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
