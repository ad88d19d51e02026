"""Reports and jobs built from the operators."""

from burnish.plans.jobs import (
    clean_customers,
    clean_materials,
    clean_orders,
    load_customers,
    load_materials,
    load_orders,
    quality_reports,
)
from burnish.plans.reports import (
    customer_quality_summary,
    customers_summary,
    date_quality,
    duplicate_keys,
    loaded_dates,
    loaded_orphans,
    loaded_rows,
    loaded_unmapped,
    master_keys,
    material_clean_rate,
    material_quality_by_category,
    materials_summary,
    missing_rate,
    order_integrity,
    order_references,
    orders_summary,
    parse_success,
    payment_distribution,
    payment_status_crosstab,
    reconciliation_summary,
    repeated_keys,
    revenue_by_category,
    row_reconciliation,
    share_of_total,
    status_distribution,
    unmapped_counts,
    value_distribution,
)

__all__ = [
    "clean_customers", "clean_materials", "clean_orders", "customer_quality_summary", "customers_summary",
    "date_quality", "duplicate_keys", "load_customers", "load_materials", "load_orders", "loaded_dates",
    "loaded_orphans", "loaded_rows", "loaded_unmapped", "master_keys", "material_clean_rate",
    "material_quality_by_category", "materials_summary", "missing_rate", "order_integrity", "order_references",
    "orders_summary", "parse_success", "payment_distribution", "payment_status_crosstab", "quality_reports",
    "reconciliation_summary", "repeated_keys", "revenue_by_category", "row_reconciliation", "share_of_total",
    "status_distribution", "unmapped_counts", "value_distribution",
]
