"""Rule packs: fixed kinds, weights, patterns and labels, held as data."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    kind: str
    weight: float
    pattern: str
    label: str
    flags: str = "i"
    # Lower-case texts of which every match holds one; empty if there are none.
    needs: tuple[str, ...] = ()
    # Whether every match starts with one of them.
    opens: bool = False


# Section rules.
SECTION_RULES = [
    Rule("retroactivity", 0.80,
         r"retroactive|shall apply to (?:any|all).*before|before the date of enactment",
         "Potential retroactive effect",
         needs=("retroactive", "shall apply to", "before the date of enactment"), opens=True),
    Rule("grandfather", 0.75,
         r"grandfather|existing agreement|in effect on the date|entered into before",
         "Existing arrangement may receive special treatment",
         needs=("grandfather", "existing agreement", "in effect on the date", "entered into before"), opens=True),
    Rule("enforcement_limit", 0.85,
         r"no private right of action|may only be enforced by|exclusive authority|"
         r"shall not bring an action",
         "Enforcement authority may be limited",
         needs=("no private right of action", "may only be enforced by", "exclusive authority", "shall not bring an action"), opens=True),
    Rule("unspecified_spending", 0.65, r"such sums as may be necessary",
         "Open-ended authorization language",
         needs=("such sums as may be necessary",), opens=True),
    Rule("named_geography", 0.55,
         r"\b(?:County|Parish|Borough|District|Municipality|City of|Town of)\b",
         "Provision contains narrow geographic language",
         needs=("county", "parish", "borough", "district", "municipality", "city of", "town of"), opens=True),
    Rule("exemption", 0.65,
         r"exempt(?:ion|ed)? from|shall not apply to|notwithstanding any other provision",
         "Potential exemption or override",
         needs=("exempt", "shall not apply to", "notwithstanding any other provision"), opens=True),
]
MONEY_RULE = Rule("money", 0.50, "", "Explicit monetary amount")
REFERENCE_RULE = Rule(
    "cross_reference_density", 0.45,
    r"\b(?:title\s+\d+|\d+\s+U\.S\.C\.|Public Law\s+\d+[–-]\d+|section\s+\d+[A-Za-z0-9()\-]*)",
    "Multiple external statutory references",
    needs=("title", "u.s.c.", "public law", "section"),
)

# Fixed value: a section heading line.
SECTION_MARKER = r"(?imUd)^\s*(?:SEC\.|SECTION)\s+(\d+[A-Z]?(?:[-.]\d+)*)[.\s—-]*(.*)$"

# Fiscal signals.
FISCAL_RULES = [
    Rule("appropriation", 0.88,
         r"\b(?:appropriat(?:e|ed|ion|ions)|general revenue fund|special fund|dedicated account)\b",
         "Appropriation or dedicated-fund language",
         needs=("appropriat", "general revenue fund", "special fund", "dedicated account"), opens=True),
    Rule("tax_change", 0.86,
         r"\b(?:tax credit|tax exemption|exempt from .*tax|deduction|taxable|tax rate|"
         r"franchise tax|sales and use tax|property tax)\b",
         "Tax-base, rate, credit, deduction, or exemption language",
         needs=("tax", "deduction")),
    Rule("fee_change", 0.82,
         r"\b(?:fee|surcharge|assessment)\b.{0,100}\b(?:increase|decrease|impose|collect|charge|"
         r"set|amount|dollar|\$)",
         "Fee, surcharge, or assessment change", "is",
         ("fee", "surcharge", "assessment"), True),
    Rule("mandate", 0.78,
         r"\b(?:shall|must|required to)\b.{0,160}\b(?:county|municipality|school district|agency|"
         r"department|local government|political subdivision)\b",
         "Required governmental implementation", "is",
         ("shall", "must", "required to"), True),
    Rule("implementation_cost", 0.78,
         r"\b(?:implementation cost|administrative cost|cost to implement|"
         r"additional full-time equivalent|FTE|technology cost|staffing cost)\b",
         "Implementation or administrative cost",
         needs=("implementation cost", "administrative cost", "cost to implement", "additional full-time equivalent", "fte", "technology cost", "staffing cost"), opens=True),
    Rule("revenue_effect", 0.80,
         r"\b(?:revenue loss|revenue gain|revenue decrease|revenue increase|loss of revenue|"
         r"gain in revenue|fiscal implication|fiscal impact)\b",
         "Revenue or fiscal-effect language",
         needs=("revenue", "fiscal im")),
    Rule("beneficiary_specific_funding", 0.72,
         r"\b(?:grant|award|payment|reimbursement|credit|subsidy|assistance)\b.{0,180}"
         r"\b(?:eligible|recipient|entity|organization|company|association|district|county|"
         r"municipality)\b",
         "Funding or benefit directed to a defined recipient class", "is",
         ("grant", "award", "payment", "reimbursement", "credit", "subsidy", "assistance"), True),
]
FISCAL_AMOUNT = Rule(
    "explicit_fiscal_amount", 0.92, "",
    "Explicit monetary amount appears in fiscal or legislative text.",
)
# Words that count as a mention of a signal in an analysis.
ANALYSIS_TERMS = {
    "appropriation": r"appropriat|general revenue|special fund|dedicated account",
    "tax_change": r"tax credit|tax exemption|deduction|tax rate|franchise tax|"
                  r"sales and use tax|property tax",
    "fee_change": r"fee|surcharge|assessment",
    "mandate": r"mandate|required|shall|must",
    "implementation_cost": r"implementation|administrative cost|FTE|staff|technology cost",
    "revenue_effect": r"revenue|fiscal impact|fiscal implication",
}

# Names and classes found in bill text, group 1 is the name.
BENEFICIARY_PATTERNS = [
    r"\b(trade associations?)\b",
    r"\b(small businesses?)\b",
    r"\b(manufacturers?)\b",
    r"\b(producers?)\b",
    r"\b(eligible (?:entities|recipients|applicants))\b",
    r"\b(nonprofit organizations?)\b",
    r"\b(tribal (?:governments|organizations|entities))\b",
    r"\b(institutions of higher education)\b",
]
# Lower-case texts of which every match of these patterns starts with one.
BENEFICIARY_NEEDS = [
    ("trade association",), ("small business",), ("manufacturer",), ("producer",),
    ("eligible entities", "eligible recipients", "eligible applicants"), ("nonprofit organization",),
    ("tribal governments", "tribal organizations", "tribal entities"), ("institutions of higher education",),
]
ORGANIZATION_PATTERN = (
    r"\b((?:[A-Z][A-Za-z0-9&.'-]*\s+){0,7}[A-Z][A-Za-z0-9&.'-]*\s+"
    r"(?:Inc\.?|Incorporated|LLC|L\.L\.C\.|Corp\.?|Corporation|Company|Co\.?|Association|"
    r"Foundation|Institute|Council|Federation|Coalition))\b"
)
GEOGRAPHY_PATTERN = (
    r"\b((?:City|Town|County|Parish|Borough|District) of (?:[A-Z][A-Za-z'-]*\s*){1,6}|"
    r"(?:[A-Z][A-Za-z'-]*\s+){1,6}(?:County|Parish|Borough|District))\b"
)
CIVIC_ORGANIZATION_PATTERN = (
    r"\b((?:[A-Z][A-Za-z0-9&.'/-]*\s+){0,7}[A-Z][A-Za-z0-9&.'/-]*\s+"
    r"(?:Inc\.?|LLC|L\.L\.C\.|LP|L\.P\.|LLP|Corp\.?|Corporation|Company|Co\.?|"
    r"Association|Foundation|Institute|Council|Partners|Development|Holdings|Group))\b"
)

# Civic signals; within a category the first pattern of the list that hits counts.
CIVIC_SIGNALS = {
    "zoning_development": [
        r"\brezon(?:e|ing)\b", r"\bzoning\b", r"\bplanned development\b", r"\bsite plan\b",
        r"\bplat\b", r"\bland use\b", r"\bcomprehensive plan\b", r"\bdevelopment agreement\b",
    ],
    "procurement_contract": [
        r"\bcontract\b", r"\bagreement\b", r"\bprocurement\b", r"\bbid\b", r"\brfp\b", r"\brfq\b",
        r"\baward(?:ed|ing)?\b", r"\bvendor\b", r"\bpurchase order\b",
    ],
    "budget_finance": [
        r"\bbudget\b", r"\bappropriat", r"\bexpenditure\b", r"\brevenue\b", r"\bfund balance\b",
        r"\bcapital improvement\b", r"\bgrant\b",
    ],
    "bond_tax_debt": [
        r"\bbond\b", r"\btax rate\b", r"\bproperty tax\b", r"\bdebt service\b",
        r"\bcertificate of obligation\b", r"\btax increment\b", r"\btirz\b",
    ],
    "school_facility_boundary": [
        r"\bschool boundary\b", r"\battendance boundary\b", r"\bcampus consolidation\b",
        r"\bcampus closure\b", r"\bfacilit(?:y|ies)\b", r"\bschool construction\b",
        r"\brenovation\b", r"\btransportation zone\b",
    ],
    "policy_rule": [
        r"\bpolicy\b", r"\bcode of conduct\b", r"\bhandbook\b", r"\bordinance\b",
        r"\bregulation\b", r"\brule\b",
    ],
    "public_hearing": [r"\bpublic hearing\b", r"\bpublic comment\b", r"\bpublic forum\b"],
    "vote_action": [
        r"\bapproved?\b", r"\badopted?\b", r"\bauthorized?\b", r"\bvote\b", r"\bmotion\b",
        r"\bresolution\b",
    ],
    "property_land": [
        r"\breal property\b", r"\bland acquisition\b", r"\bpurchase of land\b",
        r"\bsale of land\b", r"\bright[- ]of[- ]way\b", r"\beasement\b",
    ],
    "election_governance": [
        r"\belection\b", r"\bballot\b", r"\btrustee\b", r"\bcouncilmember\b",
        r"\bcommissioner\b", r"\bcharter amendment\b",
    ],
}
CIVIC_PRIORITY = [
    "zoning_development", "procurement_contract", "budget_finance", "bond_tax_debt",
    "school_facility_boundary", "property_land", "policy_rule", "election_governance",
    "public_hearing", "vote_action",
]
CIVIC_TYPE_FALLBACK = {
    "zoning": "zoning_development", "bond": "bond_tax_debt", "policy": "policy_rule",
    "public_hearing": "public_hearing", "budget": "budget_finance",
}

# Bill topics, first hit wins.
TOPICS = {
    "education": [r"\bschool\b", r"\beducation\b", r"\bstudent\b", r"\bteacher\b",
                  r"\bcollege\b", r"\buniversity\b"],
    "tax_budget": [r"\btax\b", r"\bbudget\b", r"\bappropriat", r"\brevenue\b", r"\bdebt\b",
                   r"\btreasury\b"],
    "health": [r"\bhealth\b", r"\bmedical\b", r"\bmedicaid\b", r"\bmedicare\b", r"\bhospital\b",
               r"\bdrug\b"],
    "public_safety": [r"\bcrime\b", r"\bcriminal\b", r"\bpolice\b", r"\blaw enforcement\b",
                      r"\bfirearm\b", r"\bcourt\b", r"\bprison\b"],
    "infrastructure_transportation": [r"\broad\b", r"\bhighway\b", r"\btransport", r"\brail\b",
                                      r"\bairport\b", r"\binfrastructure\b", r"\bwater\b"],
    "election_governance": [r"\belection\b", r"\bvoting\b", r"\bballot\b", r"\bgovernment\b",
                            r"\bagency\b", r"\bethics\b"],
    "business_labor": [r"\bbusiness\b", r"\bemploy", r"\blabor\b", r"\bworker\b", r"\bwage\b",
                       r"\bcommerce\b", r"\bindustry\b"],
    "environment_energy": [r"\benvironment", r"\benergy\b", r"\boil\b", r"\bgas\b",
                           r"\belectric", r"\bclimate\b", r"\bconservation\b"],
    "housing_property": [r"\bhousing\b", r"\bproperty\b", r"\breal estate\b", r"\bland\b",
                         r"\brent\b", r"\bmortgage\b"],
}

# Category labels.
CATEGORY_LABELS = {
    "zoning_development": "Development & land use",
    "procurement_contract": "Contracts & procurement",
    "budget_finance": "Budget & finance",
    "bond_tax_debt": "Taxes, bonds & debt",
    "school_facility_boundary": "Schools, facilities & boundaries",
    "policy_rule": "Policies, ordinances & rules",
    "public_hearing": "Public hearings & comment",
    "vote_action": "Votes & official actions",
    "property_land": "Property & land",
    "election_governance": "Elections & governance",
    "education": "Education",
    "tax_budget": "Taxes & budget",
    "health": "Health",
    "public_safety": "Public safety & justice",
    "infrastructure_transportation": "Infrastructure & transportation",
    "business_labor": "Business & labor",
    "environment_energy": "Environment & energy",
    "housing_property": "Housing & property",
    "other_legislation": "Other legislation",
    "other_civic": "Other civic business",
}
NOT_SUBSTANTIVE = ["other_civic", "vote_action", "public_hearing"]

# Document types, first token in title and address wins.
DOCUMENT_TYPES = [
    ("minutes", "minutes"), ("agenda", "agenda"), ("packet", "meeting_packet"),
    ("ordinance", "ordinance"), ("public hearing", "public_hearing"), ("bond", "bond"),
    ("policy", "policy"), ("zoning", "zoning"), ("consolidation", "consolidation"),
    ("budget", "budget"),
]

# Status of a legislative action, first hit wins.
ACTION_STATUS = [
    (["signed by", "became law"], "signed / enacted"),
    (["veto"], "veto action"),
    (["passed", "agreed to"], "passed / agreed to"),
    (["referred"], "referred"),
    (["introduced", "filed"], "introduced / filed"),
    (["reported", "committee"], "committee action"),
]

# Agenda structure.
AGENDA_ITEM = (
    r"(?iUd)^\s*(?:item\s+)?([IVXLCDM]+(?:\.[A-Z0-9]+)*|[A-Z]\d{1,3}|[A-Z]|"
    r"\d+(?:\.\d+)*[A-Z]?)[.):]\s*(.+)$"
)
AGENDA_VERBS = (
    "consider|discuss|approve|adopt|authorize|award|public hearing|receive|review|vote|resolution"
)
AGENDA_ACTION = rf"(?iUd)^\s*({AGENDA_VERBS})\b"
AGENDA_NUMBERED_ACTION = rf"(?iUd)^\s*(\d{{1,2}})\s+((?:{AGENDA_VERBS})\b.+)$"
AGENDA_SECTION = (
    r"(?iUd)^(?:consent agenda|regular agenda|(?:public )?hearings?|"
    r"(?:new|old|unfinished) business|election board business|"
    r"(?:work|executive|closed) session|action resulting from executive (?:action|session)|"
    r"(?:individual|general) consideration|(?:discussion|action|information) items?)$"
)
CONSENT_AGENDA = r"(?iUd)^consent agenda\s*[-:]"
CONTACT_LINE = (
    r"(?iUd)(?:^3815\s*(?:-\s*b)?\s*sachse\s*(?:road|rd)\b|"
    r"^sachse\s*(?:road|rd)\s*,?\s*building\s*b\b|"
    r"^\(?\d{3}\)?[. -]\d{3}[. -]\d{4}\b|"
    r"^(?:contact us|hours|phone|fax|helpful links)\b)"
)
CONTACT_HEADING = (
    r"(?iUd)^(?:contact us|hours|phone|fax|helpful links|meeting location|"
    r"(?:\d{3,5}\s+)?sachse\s+(?:road|rd)(?:\s+building\s+b)?|"
    r"sachse\s+(?:tx|texas)\s+75048)$"
)
CONTACT_BODY = "3815 sachse"
CONTACT_SUBJECTS = ["sachse road building b", "sachse rd building b", "3815"]
ROUTINE_AGENDA = (
    r"(?iUd)^(?:call to order|roll call|establish(?:ment of)? (?:a )?quorum|"
    r"invocation|pledge(?: of allegiance)?|opening (?:prayer|remarks)|"
    r"approval of (?:the )?(?:agenda|minutes)|approve (?:the )?(?:agenda|minutes)|"
    r"consent agenda|public (?:comment|forum|participation)|citizen(?:s|) (?:comment|forum)|"
    r"announcements?|recognitions?|presentations?|staff reports?|"
    r"board reports?|committee reports?|future agenda items?|"
    r"(?:old|new|unfinished) business|(?:discussion|action|information) items?|"
    r"executive (?:session|closed session)|reconvene|adjourn(?:ment)?)\b"
)
ROUTINE_MINUTES = r"(?Ud)\b(?:approve|approval of)\b.{0,110}\bminutes\b"
ROUTINE_BILL_ACTION = (
    r"(?iUd)\b(?:cosponsor(?:s)? added|text (?:received|available)|"
    r"read (?:the )?(?:first|second|third) time|held at the desk|"
    r"received in the (?:house|senate)|message on (?:house|senate) action)\b"
)
SUBSTANTIVE_HINT = (
    r"(?iUd)\b(?:ordinance|contract|agreement|resolution|budget|tax|zoning|bond|development|"
    r"grant|policy|school|construction|property|project|hearing|election)\b"
)

# Evidence citations such as [D3].
CITATION = r"\[([A-Z]+\d+)\]"
