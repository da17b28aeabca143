from pricemill.sources.files import (
    load_stage,
    read_delimited,
    read_listings_tsv,
    read_predictions,
    read_renamed,
    read_terms,
    save_stage,
    source_ids,
    with_row_id,
    write_predictions,
    write_term_counts,
)
from pricemill.sources.listings import LISTING_SCHEMA, actuals, listings, predictions

__all__ = [
    "LISTING_SCHEMA", "actuals", "listings", "load_stage", "predictions", "read_delimited", "read_listings_tsv",
    "read_predictions", "read_renamed", "read_terms", "save_stage", "source_ids", "with_row_id", "write_predictions",
    "write_term_counts",
]
