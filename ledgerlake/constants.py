"""Fixed values of the treasury domain: windows, thresholds and canonical spellings."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

UNMAPPED = "_unmapped"


@dataclass(frozen=True)
class Horizon:
    """The observed months (first days, both included) and the day of the snapshot that follows them."""

    first: date = date(2024, 9, 1)
    last: date = date(2026, 8, 1)
    snapshot: date = date(2026, 9, 1)


# Thresholds.
AMOUNT_SENTINEL = 1e8
VALUE_DATE_MAX_GAP_DAYS = 30
VALUE_DATE_SENTINEL_YEAR = 2090
COUNTERPARTY_PAD = 6
SCHEDULE_TOLERANCE = 0.015
MIN_HISTORY = 6

# Units of a currency for one EUR, for orders of magnitude only.
UNITS_PER_EUR = {
    "EUR": 1.0, "USD": 1.16, "GBP": 0.86, "CHF": 0.94, "AUD": 1.66, "CAD": 1.60, "NZD": 1.97,
    "SGD": 1.48, "AED": 4.24, "SAR": 4.34, "PLN": 4.26, "RON": 5.07, "BRL": 6.17, "MYR": 4.71,
    "PEN": 3.99, "ILS": 3.76, "CNY": 7.97, "DKK": 7.46, "HKD": 9.04, "NOK": 11.66, "SEK": 11.00,
    "MAD": 10.8, "GHS": 13.28, "ZAR": 19.36, "NAD": 19.41, "MXN": 21.30, "CZK": 24.44,
    "THB": 37.44, "TRY": 48.49, "PHP": 67.21, "MZN": 73.74, "RUB": 92.58, "INR": 102.71,
    "ISK": 144.75, "JPY": 173.55, "HUF": 391.63, "XOF": 655.96, "CLP": 1055.66, "AOA": 1058.02,
    "ARS": 1598.57, "COP": 4411.09, "IDR": 19303.88, "VND": 30265.15, "BAM": 1.96,
}

# Spellings of countries.
COUNTRY = {
    "ESPAÑA": "ES", "España": "ES", "ESPANYA": "ES", "Espanya": "ES", "Spain": "ES",
    "Portugal": "PT", "Italia": "IT", "Alemania": "DE", "Malaysia": "MY",
}

# Spellings of ERP systems.
ERP_CODE = {
    "Microsoft Business Central": "businessCentral", "businessCentral": "businessCentral",
    "Netsuite": "netsuite", "netsuite": "netsuite",
    "Microsoft Navision": "navision", "navision": "navision",
    "SAP Business One": "businessOne", "businessOne": "businessOne",
    "Sage 200": "sage200", "sage200": "sage200", "Sage X3": "sageX3", "sageX3": "sageX3", "Sage 50": "sage50", "sage50": "sage50",
    "SAP R3 / S4": "r3", "r3": "r3", "A3 ERP": "a3", "a3": "a3",
    "Microsoft Dynamics - F&O": "fo", "fo": "fo",
    "Microsoft Dynamics - AX 2012": "dynamicsAx", "Microsoft Dynamics - AX 2009": "dynamicsAx", "dynamicsAx": "dynamicsAx",
    "LIBRA": "libra", "libra": "libra", "Desarrollo propio": "inHouse", "inHouse": "inHouse",
    "MOVEX": "m3Rosetta", "Infor M3": "m3Rosetta", "m3Rosetta": "m3Rosetta",
    "Distrito K": "distritoK", "distritoK": "distritoK", "Odoo": "odoo", "odoo": "odoo",
    "Oracle Cloud": "oracleCloud", "oracleCloud": "oracleCloud", "Holded": "holded", "holded": "holded",
    "Etendo": "etendo", "etendo": "etendo", "Sage Intacct": "sageIntacct", "sageIntacct": "sageIntacct",
    "Ekon": "ekon", "ekon": "ekon", "DATEV": "datev", "datev": "datev", "SAP ByDesign": "sapByd", "sapByd": "sapByd",
}

# Display names of ERP systems by code.
ERP_LABEL = {
    "businessCentral": "Microsoft Business Central", "netsuite": "Netsuite", "navision": "Microsoft Navision",
    "businessOne": "SAP Business One", "sage200": "Sage 200", "sageX3": "Sage X3", "sage50": "Sage 50", "r3": "SAP R3 / S4",
    "a3": "A3 ERP", "fo": "Microsoft Dynamics - F&O", "dynamicsAx": "Microsoft Dynamics - AX", "libra": "LIBRA",
    "inHouse": "Desarrollo propio", "m3Rosetta": "Infor M3", "distritoK": "Distrito K", "odoo": "Odoo",
    "oracleCloud": "Oracle Cloud", "holded": "Holded", "etendo": "Etendo", "sageIntacct": "Sage Intacct",
    "ekon": "Ekon", "datev": "DATEV", "sapByd": "SAP ByDesign",
}

# Other aliases.
TXN_CATEGORY = {"-": "uncategorized", "cash_settlements": "cash_settlement"}
INVOICE_STATUS = {"cancel": "cancelled", "paymentOrder": "payment_order"}
BANK_NAME = {"Paypal": "PayPal", "iberCaja": "Ibercaja", "BANCO SANTANDER TOTTA SA": "Banco Santander Totta SA", "Otros": "Other (customer-defined)"}
SERVICE = {"others": "custom", "_others": "custom"}
AMORTIZATION_TYPE = {"constant quote": "constant_installment"}
AMORTISING_FREQUENCY = {"semiannually": "semi_annual"}

# Families of product types, and the types that hold cash.
TYPE_FAMILY = {
    "checking": "cash_like", "saving": "cash_like", "wallet": "cash_like", "expensesPlatform": "cash_like",
    "card": "operating", "tpv": "operating", "investment": "operating",
    "risk": "credit_adjacent", "lineofcomex": "credit_adjacent",
    "loan": "term_debt", "leasing": "term_debt", "mortgage": "term_debt", "renting": "term_debt",
    "lineofcredit": "working_capital", "factoring": "working_capital", "confirming": "working_capital", "guarantee": "contingent",
}
CASH_LIKE_TYPES = ("checking", "saving", "wallet", "expensesPlatform", "investment", "tpv")

# Categories that aren't operating flow; document types of invoices.
NON_OPERATING = ("transfer", "investment_deployment", "investment_return", "debt_repayment")
INVOICE_TYPES = ("invoice", "invoiceGroup")
