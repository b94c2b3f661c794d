"""Explicit schemas of the documents, messages and files that the operators parse."""

from __future__ import annotations

USER_DOC = "_id string, name string, login string, update_ts timestamp"
RESTAURANT_DOC = (
    "_id string, name string, menu array<struct<_id: string, name: string, price: decimal(14,2), category: string>>, update_ts timestamp"
)
ORDER_DOC = (
    "_id string, restaurant struct<id: string>, user struct<id: string>, date timestamp, "
    "order_items array<struct<id: string, name: string, price: decimal(14,2), quantity: int>>, "
    "cost decimal(14,2), statuses array<struct<status: string, dttm: timestamp>>, final_status string, update_ts timestamp"
)
BONUS_EVENT = (
    "user_id int, order_id string, order_date string, product_payments array<struct<product_id: string, product_name: string, "
    "price: decimal(14,2), quantity: int, product_cost: decimal(14,2), bonus_payment: decimal(14,2), bonus_grant: decimal(14,2)>>"
)
ORDER_MESSAGE = (
    "object_id bigint, object_type string, sent_dttm timestamp, payload struct<restaurant: struct<id: string>, date: timestamp, "
    "user: struct<id: string>, order_items: array<struct<id: string, name: string, price: decimal(19,5), category: string, quantity: int>>, "
    "bonus_payment: decimal(19,5), cost: decimal(19,5), payment: decimal(19,5), bonus_grant: decimal(19,5), "
    "statuses: array<struct<status: string, dttm: timestamp>>, final_status: string, update_ts: timestamp>"
)
ENRICHED_ORDER = (
    "object_id bigint, object_type string, payload struct<id: bigint, date: timestamp, cost: decimal(19,5), payment: decimal(19,5), "
    "status: string, restaurant: struct<id: string, name: string>, user: struct<id: string, name: string, login: string>, "
    "products: array<struct<id: string, price: decimal(19,5), quantity: int, name: string, category: string>>>"
)
ORDER_EVENTS = (
    "array<struct<object_id: string, object_type: string, payload: struct<order_id: string, user_id: string, product_id: string, "
    "product_name: string, category_id: string, category_name: string>>>"
)
TRANSACTIONS = (
    "operation_id string, account_number_from int, account_number_to int, currency_code smallint, country string, status string, "
    "transaction_type string, amount int, transaction_dt timestamp"
)
CURRENCIES = "currency_code smallint, currency_code_with smallint, date_update timestamp, currency_with_div decimal(5,3)"
CITIES = "id int, city string, lat string, lng string, timezone string"
CAMPAIGN = (
    "restaurant_id string, adv_campaign_id string, adv_campaign_content string, adv_campaign_owner string, "
    "adv_campaign_owner_contact string, adv_campaign_datetime_start bigint, adv_campaign_datetime_end bigint, datetime_created bigint"
)
