from .tables import (  # noqa: F401
    catalogue,
    clicks,
    dashboard_csv,
    load_split,
    parts_as_items,
    save_result,
    save_split,
    table,
)
