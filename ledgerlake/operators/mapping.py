"""Cleaning and canonicalising the raw tables: values are mapped, raw ones stay, defects get a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import constants as K
from ledgerlake.functions.columns import clean_text, closed_values, map_values, units_per_eur


def country(c: str) -> Column:
    x = clean_text(c)
    return F.when(F.length(x) == 2, F.upper(x)).otherwise(closed_values(x, K.COUNTRY))


def erp_code(c: str) -> Column:
    return closed_values(clean_text(c), K.ERP_CODE)


def erp_label(c: str) -> Column:
    return map_values(erp_code(c), K.ERP_LABEL)


def counterparty(c: str) -> Column:
    """The digits at the end, padded (and cut) to a fixed width; blank is null; without digits the value stays."""
    x, digits = F.col(c), F.regexp_extract(c, "([0-9]+)$", 1)
    padded = F.concat(F.lit("COUNTERPARTY_"), F.lpad(digits, K.COUNTERPARTY_PAD, "0"))
    return F.when(F.trim(x) == "", None).when(digits == "", x).otherwise(padded)


def service(c: str) -> Column:
    return map_values(F.regexp_replace(clean_text(c), "^_", ""), K.SERVICE)


def service_kind(raw: str, clean: Column) -> Column:
    """The pattern's underscore stands for any character."""
    link = F.coalesce(F.col(raw).like("ins_%"), F.lit(False)) | clean.like("ins_%")
    return F.when(clean.isNull(), None).when(clean == "custom", "custom").when(link, "connector_id").otherwise("bank_service")


def observation_start(c: str, horizon: K.Horizon) -> Column:
    return F.greatest(F.lit(horizon.first), F.trunc(c, "month"))


def positive_rate(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def product_currency(banking: DataFrame, debt: DataFrame) -> DataFrame:
    """Type and currency of each product of either catalogue."""
    both = banking.select("product_id", "type", "currency").unionByName(debt.select("product_id", "type", "currency"))
    return both.groupBy("product_id").agg(F.any_value("type", True).alias("product_type"), F.any_value("currency", True).alias("product_currency"))


def mapped_groups(groups: DataFrame) -> DataFrame:
    code = erp_code("erp")
    return groups.select("group_id", F.col("erp").alias("erp_raw"), code.alias("erp_code"), erp_label("erp").alias("erp_label"), code.alias("erp"), "n_companies_in_sample", (code == K.UNMAPPED).alias("dq_erp_unmapped"))


def mapped_companies(companies: DataFrame, banking: DataFrame, invoices: DataFrame, balances: DataFrame, horizon: K.Horizon = K.Horizon()) -> DataFrame:
    has = lambda df, name: df.select("company_id").distinct().withColumn(name, F.lit(True))
    met = companies.join(has(banking.where("type = 'checking'"), "_checking"), "company_id", "left").join(has(invoices, "_invoiced"), "company_id", "left").join(has(balances, "_balanced"), "company_id", "left")
    code, land = erp_code("erp"), country("country")
    return met.select(
        "company_id", "group_id", F.col("country").alias("country_raw"), land.alias("country"), "currency", F.col("erp").alias("erp_raw"), code.alias("erp_code"), erp_label("erp").alias("erp_label"), code.alias("erp"), "created_at",
        observation_start("created_at", horizon).alias("observation_start"), F.col("_checking").isNotNull().alias("has_checking"), F.col("_invoiced").isNotNull().alias("has_invoices"),
        F.col("_invoiced").isNotNull().alias("erp_connected"), F.col("_balanced").isNull().alias("balance_missing"), (land == K.UNMAPPED).alias("dq_country_unmapped"), (code == K.UNMAPPED).alias("dq_erp_unmapped"),
    )


def _product(df: DataFrame, horizon: K.Horizon) -> list[Column]:
    clean = service("service")
    return [
        *map(F.col, ("product_id", "company_id", "label", "type")), closed_values(F.col("type"), K.TYPE_FAMILY).alias("type_family"), F.col("bank_name").alias("bank_name_raw"), map_values(clean_text("bank_name"), K.BANK_NAME).alias("bank_name"),
        F.col("service").alias("service_raw"), clean.alias("service"), service_kind("service", clean).alias("service_kind"), F.col("currency"), F.col("created_at"),
        (F.col("created_at") > F.lit(horizon.snapshot).cast("timestamp")).alias("connected_after_cutoff"), observation_start("created_at", horizon).alias("observation_start"),
    ]


def mapped_banking_products(banking: DataFrame, horizon: K.Horizon = K.Horizon()) -> DataFrame:
    return banking.select(*_product(banking, horizon))


def mapped_debt_products(debt: DataFrame, horizon: K.Horizon = K.Horizon()) -> DataFrame:
    g, o = F.col("granted"), F.col("outstanding")
    both = g.isNotNull() & o.isNotNull()
    return debt.select(
        *_product(debt, horizon), "granted", "outstanding", g.alias("granted_raw"), o.alias("outstanding_raw"), F.abs(g).alias("granted_liability"), F.abs(o).alias("outstanding_liability"), "liquidity",
        (o > 0).alias("dq_positive_outstanding"), (both & (g != 0) & (o != 0) & (F.signum(g) != F.signum(o))).alias("dq_granted_outstanding_sign_mismatch"), (both & (F.abs(o) > F.abs(g))).alias("dq_outstanding_exceeds_granted"),
    )


def mapped_debt_schedules(schedules: DataFrame, banking: DataFrame, debt: DataFrame) -> DataFrame:
    known = banking.select("product_id").union(debt.select("product_id")).distinct().withColumnRenamed("product_id", "_known")
    owed = debt.select("product_id", F.col("granted").alias("_granted"), F.col("outstanding").alias("_outstanding"), F.lit(True).alias("_debt"))
    met = schedules.join(owed, "product_id", "left").join(known, F.col("settlement_product_id") == F.col("_known"), "left")
    apart = lambda a, b: F.coalesce(F.abs(F.abs(F.col(a)) - F.abs(F.col(b))) > K.SCHEDULE_TOLERANCE, F.lit(False))
    return met.select(
        "product_id", "company_id", F.col("settlement_product_id").alias("settlement_product_id_raw"), F.col("_known").alias("settlement_product_id"), (F.col("settlement_product_id").isNotNull() & F.col("_known").isNull()).alias("dq_settlement_orphan"), "currency",
        F.col("amortization_type").alias("amortization_type_raw"), map_values(clean_text("amortization_type"), K.AMORTIZATION_TYPE).alias("amortization_type"), "interest_calc_method",
        F.col("amortising_frequency").alias("amortising_frequency_raw"), map_values(clean_text("amortising_frequency"), K.AMORTISING_FREQUENCY).alias("amortising_frequency"),
        "granted_balance", "outstanding_balance", "total_periods", "next_payment_date", "last_payment_date", "annual_interest_rate_or_spread", "interest_type",
        (F.col("_debt").isNotNull() & (apart("granted_balance", "_granted") | apart("outstanding_balance", "_outstanding"))).alias("dq_schedule_amount_mismatch"),
    )


def mapped_balances(balances: DataFrame, banking: DataFrame, debt: DataFrame) -> DataFrame:
    """A sentinel is too large for cash, in EUR; products in no catalogue count as cash in EUR."""
    met = balances.join(product_currency(banking, debt), "product_id", "left")
    in_eur = F.col("balance") / units_per_eur(F.col("product_currency"))
    suspect = F.coalesce(F.abs(in_eur) > K.AMOUNT_SENTINEL, F.lit(False)) & (F.col("product_type").isNull() | F.col("product_type").isin(*K.CASH_LIKE_TYPES))
    return met.select("product_id", "company_id", "date", "balance", "available", "granted", "liquidity", "countable", "product_currency", in_eur.alias("balance_eur_approx"), F.when(suspect, "suspect").otherwise("ok").alias("balance_quality"), suspect.alias("dq_balance_suspect"))


def mapped_invoices(invoices: DataFrame, horizon: K.Horizon = K.Horizon()) -> DataFrame:
    day = lambda c: F.to_date(c)
    sure = lambda c: F.coalesce(c, F.lit(False))
    amount, pending = F.col("amount"), F.col("pending_amount")
    alias = sure(F.lower(F.trim("status")) == "overdue") & sure(day("payment_date") == day("due_date"))
    return invoices.select(
        "operation_id", "company_id", "document_type", "issuance_date", "due_date", F.when(~alias, F.col("payment_date")).alias("payment_date"), F.col("payment_date").alias("payment_date_raw"), alias.alias("payment_date_was_due_alias"),
        "amount", "pending_amount", "currency", "accounting_currency", positive_rate("exchange_rate").alias("exchange_rate"), F.col("exchange_rate").alias("exchange_rate_raw"), map_values(clean_text("status"), K.INVOICE_STATUS).alias("status"), F.col("status").alias("status_raw"), "concept",
        counterparty("counterparty_id").alias("counterparty_id"), F.col("counterparty_id").alias("counterparty_id_raw"),
        sure(day("due_date") < day("issuance_date")).alias("dq_due_before_issuance"), sure(day("payment_date") < day("issuance_date")).alias("dq_paid_before_issuance"), sure(F.abs(pending) > F.abs(amount)).alias("dq_pending_exceeds_amount"),
        sure((pending != 0) & (amount != 0) & (F.signum(pending) != F.signum(amount))).alias("dq_pending_sign_mismatch"), sure(F.abs(amount) / units_per_eur(F.col("currency")) > K.AMOUNT_SENTINEL).alias("dq_amount_sentinel"),
        sure(day("issuance_date") > F.lit(horizon.snapshot)).alias("dq_issued_after_snapshot"), sure(amount == 0).alias("dq_amount_zero"), (F.col("counterparty_id").isNull() | (F.trim("counterparty_id") == "")).alias("dq_counterparty_missing"),
    )


def mapped_transactions(transactions: DataFrame, banking: DataFrame, debt: DataFrame) -> DataFrame:
    met = transactions.join(product_currency(banking, debt), "product_id", "left")
    value = F.col("value_date")
    odd = value.isNull() | (F.year(value) >= K.VALUE_DATE_SENTINEL_YEAR) | (F.abs(F.datediff(value, F.col("date"))) > K.VALUE_DATE_MAX_GAP_DAYS)
    return met.select(
        "transaction_id", "company_id", "product_id", "date", value.alias("value_date_raw"), F.when(odd, F.col("date")).otherwise(value).alias("value_date_clean"), "amount", F.col("exchange_rate").alias("exchange_rate_raw"), positive_rate("exchange_rate").alias("exchange_rate"), "status", "accounting_status",
        F.col("category").alias("category_raw"), map_values(clean_text("category"), K.TXN_CATEGORY, null_to="uncategorized").alias("category"), "description", F.col("counterparty_id").alias("counterparty_id_raw"), counterparty("counterparty_id").alias("counterparty_id"), "product_currency",
        F.coalesce(F.abs("amount") / units_per_eur(F.col("product_currency")) > K.AMOUNT_SENTINEL, F.lit(False)).alias("dq_amount_sentinel"),
    )


def mapped_products(banking: DataFrame, debt: DataFrame, balances: DataFrame, transactions: DataFrame, schedules: DataFrame) -> DataFrame:
    """Every product that any table names, with the best known owner and where it is known from. Where several companies
    use a product outside the catalogues, the least id is its owner."""
    listed = lambda df, kind: df.select("product_id", F.col("company_id").alias("_c"), F.lit(kind).alias("product_class"), "type", "currency", "created_at")
    catalog = listed(banking, "banking").unionByName(listed(debt, "debt"))
    owner = lambda df, key, name: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("product_id")).agg(F.min("company_id").alias(name))
    sources = [owner(transactions, "product_id", "_t"), owner(balances, "product_id", "_b"), owner(schedules, "settlement_product_id", "_s")]
    ids = catalog.select("product_id")
    for s in sources:
        ids = ids.union(s.select("product_id"))
    out = ids.distinct().join(catalog, "product_id", "left")
    for s in sources:
        out = out.join(s, "product_id", "left")
    status = F.when(F.col("product_class").isNotNull(), "in_catalog").when(F.col("_t").isNotNull(), "txn_only").when(F.col("_b").isNotNull(), "balance_only").otherwise("settlement_only")
    return out.select("product_id", F.coalesce("_c", "_t", "_b", "_s").alias("company_id"), "product_class", "type", "currency", "created_at", status.alias("catalog_status"))


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, counter, n): what is left of each defect, one pass over each mapped table."""
    parts = []
    for name, df in sorted(tables.items()):
        flags = [c for c in df.columns if c.startswith("dq_") or c == "payment_date_was_due_alias"]
        one = df.agg(*(F.count_if(F.col(c)).alias(c) for c in flags), F.count(F.lit(1)).alias("rows"))
        parts.append(one.select(F.lit(name).alias("table"), F.explode(F.create_map(*(x for c in [*flags, "rows"] for x in (F.lit(c), F.col(c))))).alias("counter", "n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
