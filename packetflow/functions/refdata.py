"""Reference dimensions: document types, fields, entity groups. Fixed values are stated plainly; tables are built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Document types in order.
DOCUMENT_TYPES = (
    "cover_letter", "universal_title_application", "vehicle_registration_application", "dealership_supplemental_title_form", "manufacturer_certificate", "retail_certificate_of_sale", "odometer_disclosure",
    "limited_power_of_attorney", "lease_agreement", "insurance_card", "driver_license", "dealer_invoice", "check_payment", "lessor_lender_paperwork", "other",
)
#: How pages of a type are repaired; all other types go the default way.
EMBEDDED_CARD_TYPES = ("driver_license",)
FULL_PAGE_TYPES = (
    "cover_letter", "universal_title_application", "vehicle_registration_application", "dealership_supplemental_title_form", "manufacturer_certificate", "retail_certificate_of_sale", "odometer_disclosure",
    "limited_power_of_attorney", "lease_agreement", "dealer_invoice", "check_payment", "lessor_lender_paperwork",
)
#: Types that get no extraction, and no place in the output packet, in debug runs.
SKIP_EXTRACT = ("cover_letter", "universal_title_application", "vehicle_registration_application")
SKIP_APPEND = ("cover_letter", "universal_title_application", "vehicle_registration_application", "dealership_supplemental_title_form")
#: The type whose reading of a field comes first.
PRIMARY_SOURCE = {"vehicle_vin": "manufacturer_certificate", "vehicle_year": "manufacturer_certificate", "vehicle_make": "manufacturer_certificate", "purchase_price": "dealer_invoice"}
OWNER_EXCLUDED_TYPES = ("driver_license", "insurance_card", "other", "check_payment")
TYPE_BOOST = {"manufacturer_certificate": 3, "dealer_invoice": 2, "retail_certificate_of_sale": 1}
ENTITY_NAME_TOKENS = ("TRUST", "LLC", "LTD", "INC", "LEASE", "TITLING")

_PARTS = ("street", "city", "state", "zip")
#: Entity nests with their scalar fields; addresses have four parts each.
ENTITY_SCALARS = {
    "owner": ("owner_full_name", "owner_license_or_entity_id", "owner_phone"),
    "lienholder": ("lienholder_name", "lienholder_id", "lienholder_phone"),
    "dealership": ("dealership_name", "dealership_entity_id"),
    "lessee": ("lessee_name",),
}
ENTITY_ADDRESS = {nest: tuple(f"{nest}_address_{p}" for p in _PARTS) for nest in ENTITY_SCALARS}
VEHICLE_FIELDS = ("vehicle_vin", "vehicle_make", "vehicle_year", "vehicle_color", "odometer_reading")
OTHER_FIELDS = ("purchase_price", "plate_type", "driver_dob", "driver_eyes_color")
#: The fields that extraction tables carry, in their canonical order.
FIELDS = (*VEHICLE_FIELDS, *OTHER_FIELDS, *(f for n in ENTITY_SCALARS for f in (*ENTITY_SCALARS[n], *ENTITY_ADDRESS[n])))

#: Field groups and single fields each type may carry.
PROFILES = {
    "cover_letter": ("vehicle_vin", "vehicle_color", "vehicle_year", "vehicle_make", "plate_type", "purchase_price"),
    "universal_title_application": ("VEHICLE", "owner", "lienholder", "plate_type"),
    "vehicle_registration_application": ("VEHICLE", "owner", "lessee", "lienholder", "plate_type"),
    "dealership_supplemental_title_form": ("VEHICLE", "dealership", "owner", "purchase_price"),
    "manufacturer_certificate": ("VEHICLE", "dealership"),
    "retail_certificate_of_sale": ("VEHICLE", "owner", "dealership", "lienholder", "purchase_price", "plate_type"),
    "odometer_disclosure": ("VEHICLE",),
    "limited_power_of_attorney": ("vehicle_vin", "vehicle_year", "vehicle_make"),
    "lease_agreement": ("VEHICLE", "lessee", "dealership", "owner_phone", "owner_license_or_entity_id", "lienholder_name", "purchase_price"),
    "insurance_card": ("vehicle_vin", "vehicle_year", "vehicle_make"),
    "driver_license": ("driver_dob", "driver_eyes_color"),
    "dealer_invoice": ("VEHICLE", "owner", "lessee", "dealership", "lienholder", "purchase_price", "plate_type"),
    "check_payment": ("vehicle_vin",),
    "lessor_lender_paperwork": ("VEHICLE", "lessee", "lienholder", "owner_phone", "owner_license_or_entity_id"),
    "other": ("VEHICLE", "owner", "lessee", "dealership", "purchase_price", "plate_type"),
}


def profile_fields() -> list[tuple[str, str]]:
    """(document type, field): groups written out, each field once."""
    groups = {"VEHICLE": VEHICLE_FIELDS} | {n: (*ENTITY_SCALARS[n], *ENTITY_ADDRESS[n]) for n in ENTITY_SCALARS}
    return [(t, f) for t, parts in PROFILES.items() for f in dict.fromkeys(f for p in parts for f in groups.get(p, (p,)))]


def entity_fields() -> list[tuple[str, str, bool]]:
    """(nest, field, part of the address)."""
    return [(n, f, f in ENTITY_ADDRESS[n]) for n in ENTITY_SCALARS for f in (*ENTITY_SCALARS[n], *ENTITY_ADDRESS[n])]


def preprocess_mode(document_type: str | None) -> str:
    if document_type in EMBEDDED_CARD_TYPES:
        return "embedded_card"
    return "full_page_form" if document_type in FULL_PAGE_TYPES else "default"


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed size."""
    return spark.createDataFrame(rows, schema)
