"""The closed vocabularies of labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label codes and their natural names.
NAMES = {
    "PERSON_NAME": "person name", "AADHAAR": "aadhaar number", "PAN": "pan number", "PHONE": "phone number", "EMAIL": "email address", "ADDRESS": "address",
    "DOB": "date of birth", "BANK_ACCOUNT": "bank account number", "IFSC": "ifsc code", "UPI_ID": "upi id", "GSTIN": "gstin number", "VOTER_ID": "voter id number",
    "PASSPORT": "passport number", "VEHICLE_REG": "vehicle registration number", "UAN": "uan number", "ABHA": "abha health id", "EMPLOYEE_ID": "employee id", "MRN": "medical record number",
}


def to_code(name: Column) -> Column:
    """The code of a natural name; another name in upper case."""
    known = F.create_map(*map(F.lit, chain.from_iterable((v, k) for k, v in NAMES.items())))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), F.upper(F.trim(name)))


def to_name(code: Column) -> Column:
    known = F.create_map(*map(F.lit, chain.from_iterable(NAMES.items())))
    return F.coalesce(F.try_element_at(known, code), code)


#: Groups of labels in the review; other labels are of the group manual.
GROUPS = {
    "ids": ("AADHAAR", "PAN", "GSTIN", "IFSC", "BANK_ACCOUNT", "UPI_ID", "VOTER_ID", "PASSPORT", "VEHICLE_REG", "UAN", "ABHA", "EMPLOYEE_ID", "MRN"),
    "people": ("PERSON_NAME", "DOB", "GENDER"), "contact": ("PHONE", "EMAIL", "ADDRESS"), "visual": ("FACE", "SIGNATURE", "QR_CODE", "STAMP"),
}


def group_of(code: Column) -> Column:
    known = F.create_map(*map(F.lit, chain.from_iterable((c, g) for g, codes in GROUPS.items() for c in codes)))
    return F.coalesce(F.try_element_at(known, code), F.lit("manual"))
