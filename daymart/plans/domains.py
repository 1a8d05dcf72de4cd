"""Three worked models in the loader's form: retail orders, product activity, stock.

Fixed values: table, column and metric names, filters, thresholds and status codes are
the domain vocabulary the marts and checks rely on.
"""

from __future__ import annotations

from .model import DomainModel, load_model

PAID = "order_status IN ('20','30','40')"


def orders_model(paid: str = PAID, order_id: str = "order_id", pay_amount: str = "pay_amount") -> DomainModel:
    """Orders. ``paid`` is the one predicate every paid metric shares, so that cancelled
    orders never count as paid."""
    return load_model(
        {
            "domain_id": "ecommerce_order",
            "name": "Retail orders",
            "entities": {
                "Customer": {"source": "dim_customer_info_df", "primary_key": "customer_id"},
                "Order": {"source": "dwd_order_info_di", "primary_key": "order_id"},
                "OrderItem": {"source": "dwd_order_item_di", "primary_key": "item_id"},
                "Product": {"source": "dim_product_info_df", "primary_key": "product_id"},
            },
            "hierarchy": {
                "OrderStatus": {
                    "PendingPayment": "order_status = '10'",
                    "Paid": "order_status = '20'",
                    "Shipped": "order_status = '30'",
                    "Completed": "order_status = '40'",
                    "Cancelled": "order_status = '50'",
                }
            },
            "relationships": [
                {"from": "Customer", "to": "Order", "condition": "Customer.customer_id = Order.customer_id"},
                {"from": "Order", "to": "OrderItem", "join_type": "inner join", "condition": "Order.order_id = OrderItem.order_id"},
                {"from": "OrderItem", "to": "Product", "type": "N:1", "condition": "OrderItem.product_id = Product.product_id"},
            ],
            "metrics": {
                "gmv": {"expression": f"sum({pay_amount})", "filter": paid, "unit": "currency"},
                "order_count": {"expression": f"count(DISTINCT {order_id})", "unit": "orders"},
                "paid_orders": {"expression": f"count(DISTINCT {order_id})", "filter": paid, "unit": "orders"},
                "pay_rate": {"numerator": "paid_orders", "denominator": "order_count", "factor": 100, "unit": "%", "risk_threshold": "<70"},
                "avg_order_value": {"numerator": "gmv", "denominator": "paid_orders", "unit": "currency per order"},
            },
            "business_rules": ["pay amount = total - discount within 0.01", "item amount = quantity x unit price"],
            "axioms": [
                {"id": "AX-001", "statement": "every item has exactly one order"},
                {"id": "AX-002", "statement": "the order total is the sum of its items"},
                {"id": "AX-003", "statement": "pay amount is not negative"},
            ],
            "filter_rules": {
                "order_partition": {"partition": "inc_day = '$[time(yyyyMMdd,-1d)]'"},
                "valid_order": {"conditions": ["order_status != '50'"]},
            },
        }
    )


def activity_model() -> DomainModel:
    """Sessions and feature usage."""
    return load_model(
        {
            "domain_id": "saas_user_activity",
            "domain_name": "Product activity",
            "entities": [
                {"name": "User", "table": "dim_user_info_df", "primary_key": ["user_id"]},
                {"name": "Session", "table": "dwd_user_session_di", "primary_key": ["session_id"]},
                {"name": "FeatureUsage", "table": "dwd_feature_usage_di", "primary_key": ["event_id"]},
                {"name": "Org", "table": "dim_org_info_df", "primary_key": ["org_id"]},
            ],
            "metrics": [
                {"name": "dau", "formula": "count(DISTINCT user_id)", "unit": "users"},
                {"name": "total_duration", "formula": "sum(duration_seconds)", "filter": "duration_seconds > 0", "unit": "seconds"},
                {"name": "timed_sessions", "formula": "count(1)", "filter": "duration_seconds > 0", "unit": "sessions"},
                {"name": "avg_session_duration", "numerator": "total_duration", "denominator": "timed_sessions", "unit": "seconds"},
                {"name": "feature_users", "formula": "count(DISTINCT user_id)", "filter": "feature_name = '${target}'", "unit": "users"},
                {"name": "feature_penetration_rate", "numerator": "feature_users", "denominator": "dau", "factor": 100, "unit": "%", "risk_threshold": "<30"},
            ],
            "business_rules": {"churn": "no session for 30 days in a row", "session cap": "duration above 86400 s is clamped"},
            "axioms": [
                {"id": "AX-001", "statement": "every feature use has exactly one session"},
                {"id": "AX-002", "statement": "session duration is not negative"},
                {"id": "AX-003", "statement": "daily users are among the users of the 30-day window"},
            ],
            "filter_rules": {"session_partition": {"partition": "inc_day = '$[time(yyyyMMdd,-1d)]'"}},
        }
    )


def stock_model() -> DomainModel:
    """Stock snapshots joined to the SKU dimension."""
    return load_model(
        {
            "domain_id": "supply_chain_inventory",
            "name": "Stock",
            "metrics": {
                "total_stock_value": {"expression": "sum(stock_quantity * unit_cost)", "unit": "currency"},
                "stockout_count": {"expression": "count(DISTINCT sku_id)", "filter": "available_quantity < safety_stock", "unit": "skus", "risk_threshold": ">50"},
                "reorder_alert_count": {"expression": "count(DISTINCT sku_id)", "filter": "available_quantity < reorder_point", "unit": "skus"},
            },
            "computation_chains": [
                {
                    "name": "stock_pressure",
                    "steps": [
                        {"name": "available_quantity", "expression": "stock_quantity - locked_quantity"},
                        {"name": "shortfall", "expression": "greatest(reorder_point - available_quantity, 0)"},
                        {"name": "shortfall_value", "expression": "shortfall * unit_cost"},
                    ],
                }
            ],
            "axioms": [
                {"id": "AX-001", "statement": "at most one snapshot per warehouse, SKU and day"},
                {"id": "AX-002", "statement": "available = stock - locked"},
                {"id": "AX-003", "statement": "stock and locked are not negative"},
            ],
        }
    )
