"""Finish-code tables of the dialer (fixed values).

These strings must equal the dialer's codes exactly: they are matched as whole
texts, not as patterns.
"""

from __future__ import annotations

from . import semantics as S

# Raw finish code -> code without its ISDN cause suffix.
CLEAN_CODES = {
    "Unassigned Number (ISDN Cause Code 01)": "Unassigned Number",
    "No Route To Destination (ISDN Cause Code 03)": "No Route To Destination",
    "User Alerting No Answer (ISDN Cause Code 19)": "User Alerting No Answer",
    "Incoming Calls Barred Within CUG (ISDN Cause Code 55)": "Incoming Calls Barred Within CUG",
    "No User Responding (ISDN Cause Code 18)": "No User Responding",
    "Call Rejected (ISDN Cause Code 21)": "Call Rejected",
    "Invalid Number Format (ISDN Cause Code 28)": "Invalid Number Format",
    "Normal, Specified (ISDN Cause Code 31)": "Normal, Specified",
    "Recovery On Timer Expiry (ISDN Cause Code 102)": "Recovery On Timer Expiry",
    "Number Changed (ISDN Cause Code 22)": "Number Changed",
}

# Cleaned finish code -> category (D04). Anything else has no category.
CODE_CATEGORY = {
    "NoAnswer": "No answer",
    "Voicemail": "Voicemail",
    "Afgehandeld": "Effective",
    "Terugbellen": "Call back",
    "No Circuit": "Technical",
    "System Hang Up": "Technical",
    "GeenGehoor": "No answer",
    "Bel Later Terug": "Call back",
    "Unassigned Number": "Bad number",
    "No User Responding": "No answer",
    "Busy": "Busy",
    "InGesprek": "Busy",
    "Bad Number": "Bad number",
    "No Route To Destination": "Technical",
    "Reorder": "Technical",
    "Call Rejected": "Technical",
    "NotReached": "No answer",
    "Policy Scheduled": "Call back",
    "Invalid Number Format": "Bad number",
    "Normal, Specified": "Technical",
    "Ineffective Other": "Technical",
    "Remote Hang Up": "Technical",
    "NoLines": "Technical",
    "Agent not available for callback": "Technical",
    "Recovery On Timer Expiry": "Technical",
    "Vacant Code": "Technical",
    "User Alerting No Answer": "Technical",
    "Number Changed": "Bad number",
    "Failed to route call to agent.": "Technical",
    "Incoming Calls Barred Within CUG": "Technical",
    "Agent Logout": "Technical",
}


def clean_code(result):
    """Exact rewrites, every other code (and null) passes through."""
    from pyspark.sql import functions as F

    r = S._c(result)
    return F.coalesce(S.lookup(CLEAN_CODES, r), r)


def code_category(result2):
    """Category of a cleaned code; unknown codes and null give null."""
    return S.lookup(CODE_CATEGORY, result2)
